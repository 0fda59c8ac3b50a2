"""Token-ID output: flat files of unsigned integers with 64-bit document
offsets, read by memory map.

Layout of a dataset folder, per part ``NAME``: ``NAME.bin`` the ids of all its
documents one after another (unsigned 16-bit where the vocabulary fits, else
32-bit, little-endian), ``NAME.idx`` the start of each document within the part
and the part's length (int64), ``NAME.doc`` the document ids (int64) and a
byte each for null ids in ``NAME.nul``. ``manifest.json`` lists the parts in
order with their bases: the prefix sums of the parts' lengths.

Documents are range-partitioned and sorted by id and a hash of the text, so the
parts in order hold all ids in ascending order of documents, and texts that share
an id (or have none) are dealt over parts. Each task streams its texts to files
of a name of its own and returns that name; only names of tasks that succeeded
come into the manifest, so a lost executor's half-written files are never read.
The driver sees one row per part. Files are written through pyarrow's file
systems into the shared folder; local and mounted paths are memory-mapped, other
stores are read part by part.

Edge cases: a null or empty text is its end id only; null ids sort first;
rows that repeat an id are separate documents, ordered by a hash of the text; an empty table gives an empty
manifest.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import col, num_partitions, text_of
from .tokens import byte_bpe

_PART = "part long, name string, docs long, tokens long"
_ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text", wide: bool | None = None) -> dict:
    """Writes the dataset and returns its manifest. ``wide`` forces 32-bit
    files; by default 16 bits serve vocabularies of up to 65,536 ids."""
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    if wide is None:
        wide = byte_bpe(tokenizer).whole.get_vocab_size() > 1 << 16
    dtype = "<u4" if wide else "<u2"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, base = _open(folder)
        encode = byte_bpe(tokenizer).encode
        starts, total, docs, end = [], 0, 0, np.array([end_id], dtype=dtype).tobytes()
        with fs.open_output_stream(f"{base}/{name}.bin") as out, \
                fs.open_output_stream(f"{base}/{name}.doc") as ids, \
                fs.open_output_stream(f"{base}/{name}.nul") as nul, \
                fs.open_output_stream(f"{base}/{name}.idx") as idx:
            for pdf in batches:
                starts = []
                for text in pdf["text"]:
                    got = np.frombuffer(encode(text), dtype="<u4")
                    out.write(got.astype(dtype).tobytes())
                    out.write(end)
                    starts.append(total)
                    total += len(got) + 1
                docs += len(starts)
                idx.write(np.array(starts, dtype="<i8").tobytes())
                ids.write(pdf["id"].fillna(0).to_numpy().astype("<i8").tobytes())
                nul.write(pdf["id"].isna().to_numpy().astype("u1").tobytes())
            idx.write(np.array([total], dtype="<i8").tobytes())
        if docs:
            yield pd.DataFrame({"part": [part], "name": [name], "docs": [docs], "tokens": [total]})

    # long ids pass pandas as Int64-safe objects only when nulls occur, so they travel with a flag
    src = (docs.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
           .withColumn("hash", F.xxhash64("text"))
           .repartitionByRange(num_partitions(docs), "id", "hash").sortWithinPartitions("id", "hash"))
    src = src.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("null_id"), "text")

    def flagged(batches):
        for pdf in batches:
            pdf["id"] = pdf["id"].astype("Int64").mask(pdf["null_id"])
            yield pdf

    rows = sorted(src.mapInPandas(lambda b: write(flagged(b)), _PART).collect())
    parts, base_tokens = [], 0
    for r in rows:
        parts.append({"name": r["name"], "docs": r["docs"], "tokens": r["tokens"], "base": base_tokens})
        base_tokens += r["tokens"]
    manifest = {"folder": folder, "dtype": dtype, "tokens": base_tokens, "parts": parts}
    with fs.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def load_part(folder: str, name: str, dtype: str):
    """(ids, starts, doc ids, null flags) of a part; memory-mapped where the path is local."""
    fs, base = _open(folder)

    def get(ext: str, kind: str):
        path = f"{base}/{name}.{ext}"
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(path, dtype=kind, mode="r")
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read_buffer(), dtype=kind)

    return get("bin", dtype), get("idx", "<i8"), get("doc", "<i8"), get("nul", "u1")


def read_tokens(spark: SparkSession, manifest: dict) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    folder, dtype = manifest["folder"], manifest["dtype"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, base in zip(pdf["name"], pdf["base"], strict=True):
                ids, idx, doc, nul = load_part(folder, name, dtype)
                for lo in range(0, len(doc), 4096):
                    hi = min(lo + 4096, len(doc))
                    crc = [zlib.crc32(ids[idx[i]:idx[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                    yield pd.DataFrame({
                        "doc_id": pd.array(doc[lo:hi], dtype="Int64"), "start": base + idx[lo:hi],
                        "n_tokens": np.diff(idx[lo:hi + 1]), "ids_crc32": crc,
                    }).assign(doc_id=lambda d, n=nul[lo:hi]: d["doc_id"].mask(np.asarray(n, dtype=bool)))

    parts = [(i, p["name"], p["base"]) for i, p in enumerate(manifest["parts"])]
    if not parts:
        return spark.createDataFrame([], _ROW)
    plan = spark.createDataFrame(parts, "part long, name string, base long")
    return plan.repartitionByRange(len(parts), "part").mapInPandas(read, _ROW)

"""CSV sources and column-name work.

* S2: a dialect table for a folder of CSV files. The files are listed by Spark
  (the content column is not read), dealt out over tasks, and each task reads
  the first ``head_bytes`` of its files, so the bytes read per file are bounded.
  Encoding: UTF-8 with or without a byte order mark if the head decodes
  strictly, else Latin-1, in which every byte is a letter. Delimiter: the standard sniffer over
  the known delimiters, else the one that cuts the first three records into the same number of
  fields (most fields first, ties to the earlier one), else ``,``. Records are
  split with regard to quotes, and a line break inside quotes is noted.
* S1: one read per dialect and header (files whose columns come in another order
  are another header), united by column name; then S5 and S4.
* S5: names lower-cased, trimmed, spaces to underscores, a leading BOM dropped,
  synonyms mapped; two columns mapping to one name raise.
* S6: required / recommended columns, as lists and as a small report frame.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fixed as FX
from ..functions.exprs import norm_name

HEAD_BYTES, SNIFF_CHARS = 1 << 16, 4096
UTF8, UTF8_BOM, SINGLE_BYTE = FX.CSV_ENCODINGS[:3]
#: What Spark's reader calls these encodings.
SPARK_NAMES = {UTF8_BOM: UTF8, SINGLE_BYTE: "ISO-8859-1"}
_DIALECT = "file string, delimiter string, n_fields int, encoding string, multiline boolean, header array<string>"


def decode_head(head: bytes, whole: bool) -> tuple[str, str]:
    """(text, encoding) of a file's first bytes; ``whole`` if there are no more.
    A character cut off at the end of the head is no fault."""
    if head.startswith(codecs.BOM_UTF8):
        head, name = head[len(codecs.BOM_UTF8):], UTF8_BOM
    else:
        name = UTF8
    try:
        return codecs.getincrementaldecoder("utf-8")("strict").decode(head, final=whole), name
    except UnicodeDecodeError:
        return head.decode(SINGLE_BYTE), SINGLE_BYTE


def _records(text: str, delimiter: str, whole: bool, most: int = 3) -> list[list[str]]:
    """The first records that are not blank; one that the head cuts off is left out."""
    out: list[list[str]] = []
    lines = io.StringIO(text, newline="")
    try:
        for record in csv.reader(lines, delimiter=delimiter):
            cut = not whole and lines.tell() >= len(text)
            if record and not (cut and out):
                out.append(record)
            if len(out) == most:
                break
    except csv.Error:
        pass
    return out


def find_dialect(text: str, whole: bool, delimiters=FX.CSV_DELIMITERS) -> tuple[str, int | None, bool, list[str]]:
    """(delimiter, fields, a quoted line break occurs, header) of a file's head."""
    text = text.lstrip()
    counts = {}
    for d in delimiters:
        n = {len(r) for r in _records(text, d, whole)}
        counts[d] = n.pop() if len(n) == 1 else None
    try:
        best = csv.Sniffer().sniff(text[:SNIFF_CHARS], "".join(delimiters)).delimiter
    except csv.Error:
        best = None
    if best not in counts:
        best = max(delimiters, key=lambda d: counts[d] or 0) if any(counts.values()) else ","
    first = _records(text, best, whole, most=1)
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=best)
    broken = False
    try:
        broken = any("\n" in v or "\r" in v for r in rows for v in r)
    except csv.Error:
        pass
    return best, counts.get(best), broken, [h.lstrip("\ufeff") for h in first[0]] if first else []


def read_head(path: str, n: int) -> bytes:
    """The first ``n`` bytes of a (possibly compressed) file and one more, if there is one."""
    from pyarrow import fs as pafs

    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if scheme is None or scheme.group(1) == "file":
        store, at = pafs.LocalFileSystem(), re.sub(r"^file:(//)?(?=/)", "", path)
    else:
        store, at = pafs.FileSystem.from_uri(quote(path, safe="/:@"))
    with store.open_input_stream(at, compression="detect") as f:
        return f.read(n + 1)


def csv_dialects(spark: SparkSession, path: str, delimiters=FX.CSV_DELIMITERS, encoding: str | None = None,
                 head_bytes: int = HEAD_BYTES) -> DataFrame:
    """``(file, delimiter, n_fields, encoding, multiline, header)`` per file
    under ``path``. ``encoding`` fixes it for all of them; ``n_fields`` is null
    where the records differ."""
    files = spark.read.format("binaryFile").load(path).select("path")
    delimiters = list(delimiters)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file in pdf["path"]:
                head = read_head(file, head_bytes)
                whole = len(head) <= head_bytes
                head = head[:head_bytes]
                text, name = decode_head(head, whole) if encoding is None else (head.decode(encoding, "replace"), encoding)
                rows.append((file, *find_dialect(text, whole, delimiters)[:2], name, *find_dialect(text, whole, delimiters)[2:]))
            yield pd.DataFrame(rows, columns=["file", "delimiter", "n_fields", "encoding", "multiline", "header"]).astype(
                {"n_fields": "Int32"})

    parts = spark.sparkContext.defaultParallelism
    return files.repartition(parts, "path").mapInPandas(look, _DIALECT)


def normalize_columns(df: DataFrame, synonyms: dict[str, str] = FX.COLUMN_SYNONYMS) -> DataFrame:
    """Normal-form names and synonyms; raises if two columns collide."""
    names = [norm_name(c.lstrip("﻿")) for c in df.columns]
    names = [synonyms.get(n, n) for n in names]
    dup = sorted({n for n in names if names.count(n) > 1})
    if dup:
        raise ValueError(f"columns collide after normalising names: {dup}")
    return df.toDF(*names)


def coerce_dates(df: DataFrame, cols=("activity_date",)) -> DataFrame:
    """Parse date columns; unparsable values become null."""
    out = df
    for c in cols:
        if c in df.columns and dict(df.dtypes)[c] == "string":
            out = out.withColumn(c, F.try_to_timestamp(F.col(c)))
    return out


def _literal(path: str) -> str:
    """A path whose characters are not read as a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def load_csv(spark: SparkSession, path: str, sep: str | None = None, schema: StructType | None = None,
             encoding: str | None = None, normalize: bool = True, multiline: bool | None = None) -> DataFrame | None:
    """Header CSV -> normalised frame, or ``None`` when it has no rows.

    Every file is read with its own dialect: one read per (delimiter, encoding,
    quoted line breaks, header), united by column name, so the order of columns
    may differ between files; columns that only some files have are null
    elsewhere. ``sep``, ``encoding`` and ``multiline`` overrule what the heads show:
    a quoted line break that first occurs behind the head needs ``multiline=True``.

    ``schema`` gives names and types: a file's columns are matched to it by name (in
    normal form, with synonyms), others are left out. Pass it at scale: inference costs a pass over the data."""
    found = csv_dialects(spark, path, [sep] if sep else FX.CSV_DELIMITERS, encoding).where("size(header) > 0")
    # a row per file: the listing that the reads below are given anyway
    groups: dict[tuple, list[str]] = {}
    for r in found.orderBy("file").toLocalIterator():
        many = r["multiline"] if multiline is None else multiline
        groups.setdefault((sep or r["delimiter"], r["encoding"], many, tuple(r["header"])), []).append(r["file"])
    df = None
    for (delimiter, name, many, header), files in groups.items():
        r = (spark.read.option("header", True).option("sep", delimiter).option("multiLine", many).option("escape", '"')
             .option("encoding", SPARK_NAMES.get(name, name)))
        if schema is None:
            own = r.option("inferSchema", True).csv([_literal(f) for f in files])
        else:
            own = _by_name(r, [_literal(f) for f in files], header, schema)
        own = normalize_columns(own) if normalize else own
        df = own if df is None else df.unionByName(own, allowMissingColumns=True)
    return None if df is None or df.isEmpty() else coerce_dates(df)


def _by_name(reader, files: list[str], header: tuple[str, ...], schema: StructType) -> DataFrame:
    """A read in which each column of the file takes the schema's type for its name."""
    def known(name):
        name = norm_name(name)
        return FX.COLUMN_SYNONYMS.get(name, name)

    wanted = {known(f.name): f for f in schema.fields}
    at = [wanted.get(known(h)) for h in header]
    if not any(at):
        raise ValueError(f"none of the columns {list(header)} is in the schema {schema.names}")
    here = [f.name for f in at if f is not None]
    if len(here) != len(set(here)):
        raise ValueError(f"columns collide after normalising names: {list(header)}")
    own = StructType([StructField(f.name if f else f"__other{i}", f.dataType if f else StringType())
                      for i, f in enumerate(at)])
    df = reader.schema(own).option("enforceSchema", True).csv(files)
    return df.select(*[F.col(f"`{f.name}`") if f.name in here else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def load_dataset(spark: SparkSession, name: str, sf_dir: str) -> DataFrame | None:
    """S3: a named dataset (client or events mart), or a parquet table by name;
    ``None`` when unknown. Names are not normalised."""
    from .marts import client_mart, events_mart
    from .tables import TABLES, read_table
    if name in ("client_mart", "clients"):
        return client_mart(spark, sf_dir)
    if name in ("events_mart", "events_clients"):
        return events_mart(spark, sf_dir)
    if name in TABLES:
        return read_table(spark, sf_dir, name)
    return None


def validate_columns(columns: list[str]) -> tuple[bool, list[str], list[str]]:
    """(valid, missing required, missing recommended), sorted. A
    recommended column with a group of stand-ins is missing only if all of the
    group is; it is then named once."""
    names = {c.strip().lower() for c in columns}
    stand_ins = {"total_revenue": FX.VALUE_COLUMNS, "transaction_count": FX.FREQUENCY_HINT_COLUMNS}
    required = sorted(set(FX.REQUIRED_COLUMNS) - names)
    recommended = sorted(c for c in set(FX.RFM_RECOMMENDED) - names if names.isdisjoint(stand_ins.get(c, ())))
    return not required, required, recommended


def validation_report(df: DataFrame) -> DataFrame:
    """S6 as a small frame ``(kind, column)``; no job runs (schema only)."""
    ok, req, rec = validate_columns(df.columns)
    rows = [("required", c) for c in req] + [("recommended", c) for c in rec]
    return df.sparkSession.createDataFrame(rows, "kind string, column string")

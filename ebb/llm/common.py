"""Helpers shared by the operators of this subpackage.

Every operator takes DataFrames plus the names of its id and text columns and
selects only those, under internal names, so further columns of the input may
have any name.
"""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

__all__ = ["cut_lineage", "col", "hot_join", "num_partitions", "table", "text_of", "words_of"]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers of this application the package, as with
    ``--py-files``: Spark serves the archive to its executors."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='ebb-code-')}/ebb", "zip", root, "ebb")
        sc.addPyFile(archive)
        # texts may be long: small Arrow batches bound what a worker and its executor hold at once
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table; Python workers can import the package from then on."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its literal name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(col(name), F.lit(""))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8. ``bytes.split`` separates on
    exactly those six characters and ``bytes.lower`` touches A-Z only."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return (b.lower() if lower else b).split()


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that are no longer held; it
    does so when the driver's JVM collects its garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def num_partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session: the caller sizes them to the cluster."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc32_mod(id_col: Column, mod: int) -> Column:
    """``crc32(id as text) mod m``: the folds of the labelled operators."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(mod))


#: Keys that hold at least this share of the rows are joined by broadcast. Their
#: shares sum to at most one, so there are at most HOT_PARTS of them.
HOT_PARTS = 1000


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (unique in ``key``, with the number
    of rows per key in ``size``), where single keys may hold a large part of
    all rows. At most HOT_PARTS keys can hold ``total / HOT_PARTS`` rows or
    more; those rows stay where they are and meet a broadcast of that bounded
    size. All others are shuffled, and none of them is a hot key."""
    limit = max(total // HOT_PARTS, 1)
    hot = F.broadcast(keyed.where(F.col(size) > limit))
    cold = keyed.where(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(rows.join(cold, key))


#: Words whose hashes a Python worker remembers.
MEMO = 250_000
_HASHES: dict[bytes, int] = {}


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; the memory is emptied when it holds too many."""
    from xxhash import xxh64_intdigest

    memo = _HASHES
    if len(memo) > MEMO:
        memo.clear()
    get = memo.get
    out = [get(w) for w in words]
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                w = words[i]
                h = get(w)
                if h is None:
                    h = memo[w] = xxh64_intdigest(w)
                out[i] = h
    return np.array(out, dtype=np.uint64)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * _ODD
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words from the words' hashes; its time does not
    depend on k (a polynomial in an odd base, taken by prefix differences)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        if k <= 8:
            acc = np.zeros(n, dtype=np.uint64)
            for i in range(k):
                acc = acc * _ODD + h[i:i + n]
            return mix(acc)
        step = 1
        span, done = h, None
        # doubling: runs of 1, 2, 4, ... words, joined for the bits of k
        done_len = 0
        powr = _ODD
        while True:
            if k & step:
                if done is None:
                    done, done_len = span, step
                else:
                    m = len(h) - done_len - step + 1
                    done = done[:m] * powr + span[done_len:done_len + m]
                    done_len += step
            if done_len == k:
                return mix(done[:n])
            m = len(span) - step
            span = span[:m] * powr + span[step:step + m]
            powr = powr * powr
            step *= 2


def sorted_groups(batches, keys: list[str], most: int | None = None):
    """Groups of equal ``keys`` from batches that arrive sorted by them, as
    (key tuple, DataFrame). Only the group at hand is held in memory."""
    import pandas as pd

    held, key_of = [], None
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), len(pdf)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            key = tuple(k[a])
            if held and key != key_of:
                yield key_of, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            key_of = key
            held.append(pdf.iloc[a:b])
    if held:
        yield key_of, pd.concat(held) if len(held) > 1 else held[0]

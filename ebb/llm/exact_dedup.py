"""Exact dedup: group by a 128-bit content hash, keep one stable row per class
of equal texts, and compare bytes inside hash groups so that a collision never
merges different texts. DataFrame functions only.

Texts are equal when identical after deletion of ASCII white space. The row
with the most code points in its original text stays, then the smallest id.

Plan. (1) One scan writes the light rows (id, hash, lengths, digest), repeated
rows counted. (2) One aggregation keyed by (hash, normalised text) finds the
classes: the text itself is part of the key, so bytes are compared, and the
map-side combine leaves one row per text and task however often it is copied.
(3) Light rows meet their class by hash; classes with a large part of all rows
by a broadcast of bounded number, the rest by shuffle. Only hashes that hold
two or more texts (collisions) are joined by the text as well.

Edge cases: a null text counts as empty, and all texts of white space only are
equal to it. A null id loses every tie. Rows that repeat both id and text are
separate rows; exactly one of them is kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, hot_join, text_of

SPACES = " \t\n\x0b\x0c\r"
# rank = code points * STEP + (LAST - id): a larger rank stays. Ids are 64-bit,
# so LAST - id is never negative and below STEP, and the id can be read back.
LAST = "9223372036854775807"
STEP = "20000000000000000000"


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. ``content_hash`` is a parameter so that tests can force
    collisions."""
    src = docs.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("raw"))
    src = src.select("id", normalised(F.col("raw")).alias("norm"),
                     F.char_length("raw").cast("long").alias("cp"))
    # the row that stays has the largest rank: code points first, then small ids
    rank = F.expr(f"cast(cp as decimal(18,0)) * {STEP}BD"
                  f" + (cast({LAST} as decimal(20,0)) - coalesce(id, {LAST}L))").cast("decimal(38,0)")
    src = src.withColumn("h", content_hash(F.col("norm"))).withColumn("rank", rank)
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("sha")
    light = cut_lineage(
        src.select("id", "h", "rank", sha).groupBy("id", "h", "rank", "sha")
        .agg(F.count("*").alias("copies")), "op1-light")
    classes = src.groupBy("h", "norm").agg(F.max("rank").alias("best"), F.count("*").alias("size"))
    per_hash = cut_lineage(
        classes.groupBy("h").agg(F.count("*").alias("texts"), F.max("best").alias("best"),
                                 F.sum("size").alias("size")), "op1-classes")
    total = per_hash.agg(F.sum("size")).first()[0] or 0
    out = hot_join(light, per_hash.where("texts = 1").drop("texts"), "h", "size", total)
    clash = per_hash.where("texts > 1").select("h")
    if not clash.isEmpty():
        out = out.unionByName(_collided(src, clash, sha).select(out.columns))
    keep_id = F.expr(f"cast({LAST} - best % {STEP}BD as bigint)")
    return out.select(
        F.col("id").alias("doc_id"), F.when(keep_id != F.expr(f"{LAST}L"), keep_id).alias("keep_id"),
        F.col("size").alias("group_size"), (F.col("rank") == F.col("best")).alias("best_row"),
        F.col("sha").alias("text_sha256"),
        F.posexplode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth", "_"),
    ).select("doc_id", "keep_id", "group_size",
             (F.col("best_row") & (F.col("nth") == 0)).alias("kept"), "text_sha256")


def _collided(src: DataFrame, clash: DataFrame, sha: Column) -> DataFrame:
    """The rows whose hash holds several texts, joined to their class by the text."""
    rows = src.join(clash, "h", "left_semi")
    classes = rows.groupBy("h", "norm").agg(F.max("rank").alias("best"), F.count("*").alias("size"))
    return (rows.groupBy("id", "h", "norm", "rank").agg(F.count("*").alias("copies"))
            .join(classes, ["h", "norm"]).withColumn("sha", sha))

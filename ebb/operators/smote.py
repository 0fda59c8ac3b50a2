"""SMOTE oversampling (T5).

The smaller class grows to the size of the larger one. Every new row lies on the
segment between a row of the class and one of its k nearest neighbours in the
class. The draws are dealt out evenly: with ``q * n + r`` new rows each of the
n rows gives q, and the r rows first in the order of ``md5(id|seed)`` give one
more. Neighbour and place on the segment come from ``md5(id|draw|seed)``, so the
result depends neither on partitioning nor on the order of rows, and SQL can
compute the same rows.

Neighbours are exact (:func:`nearest_neighbours`). A row of the class alone in
its data is repeated as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cumulative import prefix_sums
from ..session import cut_lineage
from .neighbours import nearest_neighbours

NEIGHBOURS = 5
SEED = 42
_DIGITS, _UNIT = 8, float(16 ** 8)


def _draw(*parts: Column) -> Column:
    """Hex digits of a hash of the parts."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def _number(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, _DIGITS), 16, 10).cast("long")


def smote_draws(ids: DataFrame, wanted: int, key: str = "client_id", seed: int = SEED) -> DataFrame:
    """``(key, draw)`` for ``wanted`` new rows over the ids."""
    n = ids.count()
    if not n or wanted <= 0:
        return ids.select(F.col(key)).limit(0).withColumn("draw", F.lit(0))
    each, rest = divmod(wanted, n)
    order = F.struct(_draw(F.col(key), F.lit(seed)).alias("h"), F.col(key).alias("k"))
    ranked = prefix_sums(ids.select(F.col(key), order.alias("__order"), F.lit(1).alias("__one")), [], "__order",
                         ["__one"], rows=n) if rest else ids.select(F.col(key), F.lit(1).alias("cum___one"))
    share = F.lit(each) + F.when(F.col("cum___one") <= rest, 1).otherwise(0)
    return ranked.select(F.col(key), share.alias("share")).where("share > 0").select(
        F.col(key), F.explode(F.sequence(F.lit(1), F.col("share"))).alias("draw"))


def smote_rows(minority: DataFrame, wanted: int, key: str = "client_id", vector: str = "x",
               k: int = NEIGHBOURS, seed: int = SEED) -> DataFrame:
    """``wanted`` new rows ``(key, draw, neighbour, gap, vector)``: row ``key``
    plus ``gap`` times the way to ``neighbour`` (null: alone in its class)."""
    minority = cut_lineage(minority.select(F.col(key).cast("long").alias(key), F.col(vector).alias(vector)), "smote-rows")
    near = nearest_neighbours(minority, k, key, vector)
    near = near.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("near"))
    drawn = smote_draws(minority.select(key), wanted, key, seed).join(near, key, "left")
    digest = _draw(F.col(key), F.col("draw"), F.lit(seed))
    pick = F.pmod(_number(digest, 1), F.size("near")).cast("int")
    drawn = drawn.withColumns({
        "neighbour": F.when(F.size("near") > 0, F.get("near", pick)["neighbour"]),
        "gap": F.when(F.size("near") > 0, _number(digest, 1 + _DIGITS) / F.lit(_UNIT)).otherwise(F.lit(0.0))})
    here = drawn.drop("near").join(minority.withColumnRenamed(vector, "__a"), key)
    there = minority.select(F.col(key).alias("neighbour"), F.col(vector).alias("__b"))
    out = here.join(there, "neighbour", "left")
    mixed = F.zip_with("__a", F.coalesce("__b", "__a"), lambda a, b: a + F.col("gap") * (b - a))
    return out.select(key, "draw", "neighbour", "gap", mixed.alias(vector))


def oversample(data: DataFrame, label: str = "label", key: str = "client_id", vector: str = "x",
               k: int = NEIGHBOURS, seed: int = SEED) -> DataFrame:
    """``(label, vector)``: all rows of two classes and the new rows that make
    them equally large. ``k`` is cut to the other rows of the class."""
    counts = {r[0]: r[1] for r in data.groupBy(label).count().collect()}
    if len(counts) != 2:
        raise ValueError("oversampling needs two classes")
    small, large = sorted(counts, key=lambda y: (counts[y], -float(y)))
    own = data.where(F.col(label) == small).select(key, vector)
    new = smote_rows(own, counts[large] - counts[small], key, vector, min(k, counts[small] - 1), seed)
    return data.select(label, vector).unionByName(
        new.select(F.lit(small).cast(data.schema[label].dataType).alias(label), vector))

"""Running totals in value order without a single-task window.

``Window.partitionBy(g).orderBy(v)`` with an unbounded frame puts every row of
group ``g`` into one task. For a KS statistic or a ROC curve over billions of
distinct scores that is the bottleneck. ``prefix_sums`` deals the rows out by
range (``repartitionByRange`` over group and value, into as many ranges as the
row count asks for), turns the totals of the ranges into offsets with a window
over that small table, and adds the offsets to running sums inside each range.
Exact, and the largest window partition is about ``rows_per_bucket`` rows
whatever the size of the input.

Rows should already be collapsed to one row per ``(group, order value)`` so a
hot value is one row, and written (``cut_lineage``), as they are read more than
once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_PER_BUCKET = 100_000


def place(df: DataFrame, by: Sequence[str], order: str, descending: bool = False,
          rows_per_bucket: int = ROWS_PER_BUCKET, rows: int | None = None) -> DataFrame:
    """Adds ``_b``: the number of the range a row lies in, rising in ``order``
    inside each group. The ranges are written once, so their numbers hold for
    every later read."""
    parts = max(1, math.ceil((df.count() if rows is None else rows) / rows_per_bucket))
    if parts == 1:
        return df.withColumn("_b", F.lit(0))
    o = F.col(order).desc() if descending else F.col(order).asc()
    dealt = df.repartitionByRange(parts, *[F.col(b) for b in by], o)
    return cut_lineage(dealt.withColumn("_b", F.spark_partition_id()), "ranges")


def prefix_sums(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str],
                rows_per_bucket: int = ROWS_PER_BUCKET, descending: bool = False,
                out_prefix: str = "cum_", rows: int | None = None) -> DataFrame:
    """Add inclusive running sums ``cum_<s>`` of ``sums`` in ``order`` per ``by``.

    ``order`` must be unique within a group. ``descending`` runs from the
    largest value down. Groups may be few or many and of any size. ``rows`` is
    the number of rows, where the caller knows it.
    """
    by = list(by)
    cols = list(df.columns)
    b = place(df, by, order, descending, rows_per_bucket, rows)
    o = F.col(order).desc() if descending else F.col(order).asc()
    # a row per group and range it reaches into
    tot = b.groupBy(*by, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    wb = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_b").alias("_g_b"),
                      *[F.coalesce(F.sum(f"_t_{s}").over(wb), F.lit(0)).alias(f"_o_{s}") for s in sums])
    w = (Window.partitionBy(*by, "_b").orderBy(o)
         .rowsBetween(Window.unboundedPreceding, 0))
    local = b.select(*cols, "_b", *[F.sum(s).over(w).alias(f"_l_{s}") for s in sums])
    same = F.col("_b") == F.col("_g_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return local.join(offs, same).select(
        *cols, *[(F.col(f"_o_{s}") + F.col(f"_l_{s}")).alias(f"{out_prefix}{s}") for s in sums])

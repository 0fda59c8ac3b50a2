"""Exact linear quantiles that scale.

Spark's exact ``percentile`` merges a value->count map of every distinct value
of a group into one task, which does not survive billions of distinct doubles.
``percentile_approx`` scales but returns an element, not the linear
interpolation the reference uses (pandas ``quantile`` / ``qcut``).

``quantiles`` gets both: an approximate pass brackets the exact answer, a second
pass counts rows below each bracket and keeps only the distinct values inside
it, and a small window over those candidates finds the exact order statistics.

* Pass 1: one sketch per group (``percentile_approx`` at ``p - d`` and ``p + d``
  for all probabilities, ``d = 2/accuracy``) and ``count``. Its rank error is at
  most ``n/accuracy``, so the true order statistics at ``floor((n-1)p)`` and
  the next rank lie inside ``[lo, hi]``.
* Pass 2: every row is compared with the (few) brackets of its group and keeps
  one array of sides (below, inside, above). Rows outside all brackets are
  combined per array (a count, a max and a min); rows inside one are collapsed
  to ``(value, count)``, so one hot value that holds a third of all rows stays
  one row. Rows are not multiplied by the number of probabilities, and partial
  aggregation runs before the shuffle.
* The candidates, about ``4n/accuracy`` distinct values per bracket at most, are
  written once; their ranks are running totals by :func:`prefix_sums`, so no
  task sorts more than a fixed number of them, whatever ``n``.
* Should a bracket miss its rank, the brackets are widened and the passes
  repeated; at full width they hold every value.

The interpolation is ``lo*(1-frac) + hi*frac`` with ``frac = (n-1)p -
floor((n-1)p)``, and exactly ``lo`` when ``lo == hi``. The multiply-add is
fused (emulated exactly with error-free transformations), which is how the
compiled SQL oracle evaluates the same formula, so edges agree bit for bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .cumulative import ROWS_PER_BUCKET, prefix_sums

DEFAULT_ACCURACY = 10000
_G = "__grp"


def quantiles(df: DataFrame, value: str | Column, probs: Sequence[float],
              by: Sequence[str] = (), accuracy: int = DEFAULT_ACCURACY,
              method: str = "exact", out: str = "edges",
              broadcast_groups: bool = False, empty_groups: bool = True,
              rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Linear quantiles of ``value`` (nulls ignored) per group.

    Returns one row per group: the ``by`` columns, ``n`` (non-null count) and
    ``out`` = ``array<double>`` with one entry per probability, in the order of
    ``probs``. Groups with no non-null value get ``n = 0`` and a null array;
    ``empty_groups=False`` leaves them out and saves the pass that finds them. A
    null is a group like any other.

    ``broadcast_groups=True`` broadcasts the bracket row of each group: for a
    bounded number of groups (features, metrics, columns), whose rows then
    stay where they are. Otherwise the planner and AQE pick the join by size.
    ``method="approx"`` skips the refinement and returns ``percentile_approx``
    elements. The exact method runs jobs while it is built.
    """
    probs = [float(p) for p in probs]
    by = list(by)
    v = F.col(value) if isinstance(value, str) else value
    base = df.select(*[F.col(b) for b in by], v.cast("double").alias("v"))
    if not by:
        base = base.withColumn(_G, F.lit(0))
    keys = by or [_G]
    groups = base.select(*keys).distinct() if by and empty_groups else None
    base = base.where(F.col("v").isNotNull() & ~F.isnan("v"))
    if method == "approx":
        return _finish(df, _sketch(base, keys, probs, accuracy, out), groups if by else (), keys, out)
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")

    slack = 2.0 / accuracy
    while True:
        cand = cut_lineage(_candidates(base, keys, probs, slack, accuracy, broadcast_groups or not by),
                           "quantile-candidates")
        rows, missed = _check(cand, keys, probs)
        if slack >= 1 or not missed:
            break
        slack *= 8
    return _finish(df, _pick(cand, keys, probs, out, rows, rows_per_bucket), groups if by else (), keys, out)


def _sketch(base: DataFrame, keys: list[str], probs: Sequence[float], accuracy: int, out: str) -> DataFrame:
    at = F.array(*[F.lit(p) for p in probs])
    return base.groupBy(*keys).agg(F.count("v").alias("n"), F.percentile_approx("v", at, accuracy).alias(out))


def _candidates(base: DataFrame, keys: list[str], probs: list[float], slack: float, accuracy: int,
                broadcast: bool) -> DataFrame:
    """Rows ``(keys, n, i, cls, x, c)`` per probability ``i``: the values inside
    its bracket with their counts (cls 1), the largest value below it with the
    count of all below (0) and the smallest above it (2). These neighbours
    cover the one-rank slack of the sketch on small groups."""
    m = len(probs)
    ends = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    brackets = _sketch(base, keys, ends, accuracy, "ends")
    if broadcast:  # a bounded number of groups, or one row
        brackets = F.broadcast(brackets)
    v, e = F.col("v"), F.col("ends")
    side = F.array(*[F.when(v < e[i], 0).when(v > e[m + i], 2).otherwise(1) for i in range(m)])
    tagged = _null_safe(base, brackets, keys).select(*keys, "n", "v", side.alias("side"))
    counted = (tagged.groupBy(*keys, "n", "side", F.when(F.array_contains("side", 1), v).alias("at"))
               .agg(F.count(F.lit(1)).alias("c"), F.max("v").alias("vmax"), F.min("v").alias("vmin")))
    each = counted.select(*keys, "n", "at", "c", "vmax", "vmin", F.posexplode("side").alias("i", "cls"))
    summed = (each.groupBy(*keys, "n", "i", "cls", F.when(F.col("cls") == 1, F.col("at")).alias("at"))
              .agg(F.sum("c").alias("c"), F.max("vmax").alias("vmax"), F.min("vmin").alias("vmin")))
    x = F.when(F.col("cls") == 0, F.col("vmax")).when(F.col("cls") == 1, F.col("at")).otherwise(F.col("vmin"))
    return summed.select(*keys, "n", "i", "cls", x.alias("x"),
                         F.when(F.col("cls") == 2, F.lit(1)).otherwise(F.col("c")).alias("c"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet; the left side's keys stay."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    return left.join(right, same, how).drop(*[f"__right_{k}" for k in keys])


def _rank(probs: list[float]) -> Column:
    return (F.col("n") - 1).cast("double") * F.array(*[F.lit(p) for p in probs])[F.col("i")]


def _check(cand: DataFrame, keys: list[str], probs: list[float]) -> tuple[int, int]:
    """The number of candidates, and of brackets whose rank lies further out than their neighbours."""
    held = cand.groupBy(*keys, "n", "i").agg(
        F.sum(F.when(F.col("cls") == 0, F.col("c")).otherwise(0)).alias("below"),
        F.sum("c").alias("known"), F.count("c").alias("rows"))
    rn = _rank(probs)
    missed = (F.floor(rn) < F.col("below") - 1) | (F.ceil(rn) >= F.col("known"))
    return tuple(held.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count_if(missed)).first())


def _pick(cand: DataFrame, keys: list[str], probs: list[float], out: str, rows: int,
          rows_per_bucket: int) -> DataFrame:
    """The order statistics at the ranks, interpolated."""
    ranked = (prefix_sums(cand, [*keys, "i"], "x", ["c"], rows_per_bucket, rows=rows)
              .withColumnRenamed("cum_c", "cum").withColumn("rn", _rank(probs))
              .withColumn("k", F.floor("rn").cast("long"))
              .withColumn("k1", F.ceil("rn").cast("long")))

    # value at 0-based rank r: the entry with cum - c <= r < cum
    def at(r):
        return F.when((F.col("cum") - F.col("c") <= r) & (r < F.col("cum")), F.col("x"))

    picked = ranked.groupBy(*keys, "n", "i").agg(
        F.max(at(F.col("k"))).alias("v_lo"), F.max(at(F.col("k1"))).alias("v_hi"),
        F.first("rn").alias("rn"), F.first("k").alias("k"))
    frac = F.col("rn") - F.col("k")
    edge = F.when(F.col("v_lo") == F.col("v_hi"), F.col("v_lo")).otherwise(
        lerp(F.col("v_lo"), F.col("v_hi"), frac))
    return picked.groupBy(*keys, "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", edge.alias("e")))),
                    lambda s: s["e"]).alias(out))


def weighted_quantiles(counts: DataFrame, value: str, weight: str, probs: Sequence[float], by: Sequence[str],
                       out: str = "edges", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """:func:`quantiles` of values that are already counted: one row per group
    and value, repeated ``weight`` times. One pass of running totals, no sketch.
    For a bounded number of groups, whose totals are broadcast; groups without values are left out."""
    by = list(by)
    base = counts.select(*by, F.col(value).cast("double").alias("x"), F.col(weight).cast("long").alias("c"))
    base = base.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.col("c") > 0))
    totals = base.groupBy(*by).agg(F.sum("c").alias("n"))
    ranked = _null_safe(prefix_sums(base, by, "x", ["c"], rows_per_bucket), F.broadcast(totals), by)
    rank = lambda i: (F.col("n") - 1).cast("double") * F.lit(float(probs[i]))
    here = lambda r: (F.col("cum_c") - F.col("c") <= r) & (r < F.col("cum_c"))
    found = F.array_compact(F.array(*[
        F.when(here(F.floor(rank(i))) | here(F.ceil(rank(i))), F.struct(
            F.lit(i).alias("i"), F.when(here(F.floor(rank(i))), F.col("x")).alias("lo"),
            F.when(here(F.ceil(rank(i))), F.col("x")).alias("hi"), (rank(i) - F.floor(rank(i))).alias("frac")))
        for i in range(len(probs))]))
    hits = ranked.select(*by, "n", F.explode(found).alias("s")).groupBy(*by, "n", "s.i").agg(
        F.max("s.lo").alias("lo"), F.max("s.hi").alias("hi"), F.first("s.frac").alias("frac"))
    edge = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(lerp(F.col("lo"), F.col("hi"), F.col("frac")))
    return hits.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", edge.alias("e")))),
                                                  lambda s: s["e"]).alias(out))


def _two_prod(a: Column, b: Column) -> tuple[Column, Column]:
    """``a*b = p + e`` exactly (Veltkamp split, Dekker product)."""
    split = F.lit(134217729.0)  # 2**27 + 1
    p = a * b
    ta, tb = split * a, split * b
    ah, bh = ta - (ta - a), tb - (tb - b)
    al, bl = a - ah, b - bh
    e = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    return p, e


def fma(a: Column, b: Column, c: Column) -> Column:
    """``round(a*b + c)`` with a single rounding, from plain double arithmetic."""
    p, e = _two_prod(a, b)
    s = p + c
    bb = s - p
    t = (p - (s - bb)) + (c - bb)
    return s + (t + e)


def lerp(lo: Column, hi: Column, frac: Column) -> Column:
    """``lo*(1-frac) + hi*frac`` with the multiply-add fused, as the SQL
    oracle's compiled ``quantile_cont`` evaluates it, so interpolated
    quantiles agree to the last bit."""
    return fma(lo, F.lit(1.0) - frac, hi * frac)


def _finish(df: DataFrame, res: DataFrame, groups: DataFrame | None | tuple, keys: list[str], out: str) -> DataFrame:
    """``groups``: those to be in the result, None for the ones with values, () for one group of all rows."""
    if isinstance(groups, DataFrame):
        return _null_safe(groups, res, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), out)
    if groups == ():
        # a global quantile always yields exactly one row, even on empty input
        one = df.sparkSession.range(1).select(F.lit(0).alias(_G))
        res = one.join(res, _G, "left").select(
            F.coalesce("n", F.lit(0)).alias("n"), out)
    return res


def quantile_scalar(df: DataFrame, value: str | Column, probs: Sequence[float],
                    **kw) -> Column:
    """Global quantiles as a lazy scalar-subquery column (``array<double>``)."""
    return quantiles(df, value, probs, **kw).select(kw.get("out", "edges")).scalar()

"""Clients over time: churn horizons, lag and trend features, segment moves.

All three start from one aggregation per client and period (day or month) with a
map-side combine, so a client with a large part of all events is a bounded number
of rows before anything is shuffled on; what follows holds at most one row per
client and period of the calendar.

* :func:`horizon_labels`: point-in-time snapshots. An active day serves the
  snapshots whose look-back it lies in (features) and those whose longest
  horizon it lies in (labels). It is dealt to exactly these, a bounded range,
  and one aggregation per (client, snapshot) makes features and all labels, so
  features never see the label's days. No join, one scan of the events.
* :func:`lag_trend_features`: a gap-filled client x period panel. A client's
  periods are one array, lags are positions in it, and the trend is the
  least-squares slope over the last periods in integer arithmetic.
* :func:`segment_transitions`: RFM per month over a trailing window, with the
  quartile edges of all months from one grouped pass, then the moves from month
  to month, with ``absent`` for clients that appear or leave.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bin_by_cuts, bin_cuts, segment_rule
from ..functions.quantiles import DEFAULT_ACCURACY, quantiles
from ..session import cut_lineage
from .rfm import QUARTILE_PROBS

HORIZONS = (7, 14, 30, 60, 90)
ABSENT = "absent"
EPOCH = "1970-01-01"


def _per_period(events: DataFrame, key: str, period: Column, value: str) -> DataFrame:
    """(key, p, n, v): events and exact sum of values per client and numbered period."""
    v = F.col(value).cast("decimal(18,4)")
    src = events.select(F.col(key).alias(key), period.cast("long").alias("p"), v.alias("v"))
    return src.where(F.col(key).isNotNull() & F.col("p").isNotNull()).groupBy(key, "p").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).cast("decimal(28,4)").alias("v"))


def day_number(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit(EPOCH).cast("date"))


def month_number(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def horizon_labels(events: DataFrame, key: str = "user_id", ts: str = "ts", value: str = "value",
                   horizons: Sequence[int] = HORIZONS, lookback: int = 30, step: int = 7) -> DataFrame:
    """One row per snapshot and client with an event in the ``lookback`` days up to it.

    Snapshots lie ``step`` days apart and end with the last day of the events.
    ``churn_h`` is 1 if the client has no event in the ``h`` days after the
    snapshot, and null while these days are not over. Events without a client
    or time are left out; an empty table gives no rows."""
    days = cut_lineage(_per_period(events, key, day_number(F.col(ts)), value), "active-days")
    last, first = days.select(F.max("p")).scalar(), days.select(F.min("p")).scalar()
    ahead = F.lit(max(horizons))
    # snapshot i is the day `last - i * step`; a day serves those from `p - ahead` to `p + lookback - 1`
    newest = F.greatest(F.ceil((last - F.col("p") - F.lit(lookback - 1)) / step), F.lit(0))
    oldest = F.least(F.floor((last - F.col("p") + ahead) / step), F.floor((last - first) / step))
    dealt = days.withColumns({"newest": newest.cast("long"), "oldest": oldest.cast("long")}).where("newest <= oldest")
    dealt = dealt.withColumn("i", F.explode(F.sequence("newest", "oldest"))).withColumn("s", last - F.col("i") * step)
    before = F.col("p") <= F.col("s")
    g = dealt.groupBy(key, "s").agg(
        F.sum(F.when(before, F.col("n"))).alias("n_events"), F.sum(F.when(before, F.col("v"))).alias("value_sum"),
        F.count_if(before).alias("active_days"), F.max(F.when(before, F.col("p"))).alias("seen"),
        F.min(F.when(~before, F.col("p"))).alias("back")).where("active_days > 0")
    labels = [F.when(F.col("s") + h <= last, F.coalesce(F.col("back") > F.col("s") + h, F.lit(True)).cast("int"))
              .alias(f"churn_{h}") for h in horizons]
    return g.select(key, F.date_add(F.lit(EPOCH).cast("date"), F.col("s").cast("int")).alias("snapshot"), "n_events",
                    "active_days", F.col("value_sum").cast("double").alias("value_sum"),
                    (F.col("s") - F.col("seen")).alias("days_since_last"), *labels)


def horizon_rates(labels: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Per horizon: snapshots with a label, churned ones, and their share (null without any)."""
    row = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"churn_{h}").alias("y")) for h in horizons]))
    g = labels.select(row.alias("r")).select("r.*").groupBy("horizon").agg(
        F.count("y").alias("n_labelled"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_churned"))
    return g.withColumn("churn_rate", F.when(F.col("n_labelled") > 0, F.col("n_churned") / F.col("n_labelled")))


def lag_trend_features(events: DataFrame, key: str = "user_id", ts: str = "ts", value: str = "value",
                       period_days: int = 7, lags: Sequence[int] = (1, 2, 4), trend: int = 4) -> DataFrame:
    """The panel: one row per client and period from its first one to the last
    of the table, periods without events as zeros.

    ``n_lag_k`` and ``value_lag_k`` are k periods earlier (null before the first);
    ``trend`` is the slope of the counts over the last ``trend`` periods, this one
    included (null with fewer than two), ``direction`` its sign in words."""
    number = F.floor(day_number(F.col(ts)) / period_days)
    counts = cut_lineage(_per_period(events, key, number, value), "active-periods")
    last = counts.select(F.max("p")).scalar()
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(28,4)").alias("v"))
    # a client has one entry per period at most, so its array is bounded by the calendar
    per = counts.groupBy(key).agg(F.min("p").alias("first"),
                                  F.map_from_entries(F.collect_list(F.struct("p", F.struct("n", "v")))).alias("m"))
    per = per.withColumn("periods", F.sequence(F.col("first"), last))
    per = per.withColumn("panel", F.transform("periods", lambda p: F.coalesce(F.try_element_at("m", p), zero)))
    out = per.select(key, "panel", F.posexplode("periods").alias("i", "p"))

    def at(k: int) -> Column:
        return F.when(F.col("i") >= k, F.get("panel", F.col("i") - k))

    # with x = 0, 1, ..., w-1: slope = (w * sum(x y) - sum(x) * sum(y)) / (w * sum(x^2) - sum(x)^2)
    w = F.least(F.col("i") + 1, F.lit(trend)).cast("long")
    window = F.slice("panel", F.col("i") - w + 2, w)
    sum_y = F.aggregate(window, F.lit(0).cast("long"), lambda a, s: a + s["n"])
    sum_xy = F.aggregate(F.transform(window, lambda s, j: s["n"] * j), F.lit(0).cast("long"), lambda a, s: a + s)
    sum_x = F.floor(w * (w - 1) / 2)
    sum_xx = F.floor((w - 1) * w * (2 * w - 1) / 6)
    slope = F.when(w > 1, (w * sum_xy - sum_x * sum_y).cast("double") / (w * sum_xx - sum_x * sum_x).cast("double"))
    out = out.withColumn("trend", slope)
    here = F.get("panel", F.col("i"))
    return out.select(
        key, F.date_add(F.lit(EPOCH).cast("date"), (F.col("p") * period_days).cast("int")).alias("period"),
        here["n"].alias("n"), here["v"].cast("double").alias("value"),
        *[c for k in lags for c in (at(k)["n"].alias(f"n_lag_{k}"), at(k)["v"].cast("double").alias(f"value_lag_{k}"))],
        "trend", F.when(F.col("trend") > 0, "rising").when(F.col("trend") < 0, "falling")
        .when(F.col("trend") == 0, "flat").alias("direction"))


def monthly_segments(orders: DataFrame, key: str = "o_custkey", ts: str = "o_orderdate", value: str = "o_totalprice",
                     window: int = 12, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """``(key, month, segment)``: RFM per month over the ``window`` months up to
    it, for clients with an order in them. Recency counts months; ``month`` is
    the first day of the month."""
    months = cut_lineage(_per_period(orders, key, month_number(F.col(ts)), value), "active-months")
    last = months.select(F.max("p")).scalar()
    served = F.sequence(F.col("p"), F.least(last, F.col("p") + window - 1))
    state = months.withColumn("month", F.explode(served)).groupBy(key, "month").agg(
        (F.col("month") - F.max("p")).alias("r"), F.sum("n").alias("f"), F.sum("v").alias("m"))
    state = cut_lineage(state.select(key, "month", F.col("r").cast("double").alias("r"), F.col("f").cast("double").alias("f"),
                                     F.col("m").cast("double").alias("m")), "monthly-rfm")
    long = state.select("month", F.expr("stack(3, 'r', r, 'f', f, 'm', m) AS (metric, v)"))
    edges = quantiles(long, "v", QUARTILE_PROBS, by=["month", "metric"], accuracy=accuracy, broadcast_groups=True,
                      empty_groups=False)
    # a row per month of the calendar, with cuts that are found once per month and not per client
    edges = edges.groupBy("month").agg(*[F.max(F.when(F.col("metric") == c, F.col("edges"))).alias(f"e_{c}") for c in "rfm"])
    cuts = edges.select("month", *[cut.alias(f"{c}_{i}") for c in "rfm" for i, cut in enumerate(bin_cuts(F.col(f"e_{c}")))])
    scored = state.join(F.broadcast(cuts), "month")
    scored = scored.select(key, "month", *[
        bin_by_cuts(F.col(c), [F.col(f"{c}_{i}") for i in range(3)]).alias(f"b_{c}") for c in "rfm"])
    r, f, m = (F.col(f"b_{c}") for c in "rfm")
    month = F.make_date(F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1).cast("int"), F.lit(1))
    return scored.select(key, month.alias("month"), segment_rule(F.lit(5) - r, f, m).alias("segment"))


def segment_transitions(segments: DataFrame, key: str = "o_custkey") -> DataFrame:
    """Moves between consecutive months: month (of arrival), from_segment,
    to_segment, clients, and their share of the clients of ``from_segment``.

    ``absent`` stands for clients without a segment in the month before or
    after; each client's rows are read once, in the order of months."""
    w = Window.partitionBy(key).orderBy("month")
    first, last = segments.select(F.min("month")).scalar(), segments.select(F.max("month")).scalar()
    rows = segments.select(key, "month", "segment", F.lag("month").over(w).alias("p_month"),
                           F.lag("segment").over(w).alias("p_segment"), F.lead("month").over(w).alias("n_month"))
    stays = F.col("p_month").eqNullSafe(F.add_months("month", -1))
    next_month = F.add_months("month", 1)
    arrive = F.when(stays | (F.col("month") > first), F.struct(
        F.col("month"), F.when(stays, F.col("p_segment")).otherwise(ABSENT).alias("from_segment"),
        F.col("segment").alias("to_segment")))
    leave = F.when((F.col("month") < last) & ~F.col("n_month").eqNullSafe(next_month), F.struct(
        next_month.alias("month"), F.col("segment").alias("from_segment"), F.lit(ABSENT).alias("to_segment")))
    moves = rows.select(F.explode(F.array_compact(F.array(arrive, leave))).alias("m")).select("m.*")
    g = moves.groupBy("month", "from_segment", "to_segment").agg(F.count("*").alias("clients"))
    # at most 6 x 6 rows per month
    total = F.sum("clients").over(Window.partitionBy("month", "from_segment"))
    return g.withColumn("share", F.col("clients") / total)

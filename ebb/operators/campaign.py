"""Value of a retention campaign: lift, money saved, top-N return, budget.

Ranks and running costs are totals over ranges (:func:`prefix_sums`), so no task
sorts all clients. Money is summed as whole cents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cumulative import prefix_sums
from ..session import cut_lineage
from .metrics import score_counts


def lift_top_share(scored: DataFrame, label: str = "label", score: str = "score", share: float = 0.1) -> DataFrame:
    """One row: how much denser positives are among the ``share`` of rows with
    the highest scores than among all. The edge may cut through rows of one
    score: these are counted in proportion. Null without a positive row."""
    counts = cut_lineage(score_counts(scored, label, score, []).withColumn("cnt", F.col("pos") + F.col("neg")), "score-counts")
    n, p = counts.select(F.sum("cnt")).scalar(), counts.select(F.sum("pos")).scalar()
    ranked = prefix_sums(counts, [], "score", ["cnt"], descending=True)
    inside = F.least(F.greatest(F.lit(share) * n - (F.col("cum_cnt") - F.col("cnt")), F.lit(0.0)), F.col("cnt").cast("double"))
    # terms differ from whole counts at the edge only, so their order does not matter
    whole = F.sum(F.when(inside == F.col("cnt"), F.col("pos")).otherwise(0))
    edge = F.max(F.when((inside > 0) & (inside < F.col("cnt")), F.col("pos") * inside / F.col("cnt")))
    g = ranked.agg(F.sum("cnt").alias("n_rows"), F.sum("pos").alias("n_positive"),
                   (F.coalesce(whole, F.lit(0)) + F.coalesce(edge, F.lit(0.0))).alias("top_positive"))
    return g.withColumn("lift", F.when(p > 0, (F.col("top_positive") / (F.lit(share) * n)) / (p / n)))


def cents(c: Column) -> Column:
    return F.round(c.cast("decimal(28,6)") * 100).cast("long")


def money_saved(scored: DataFrame, label: str = "label", score: str = "score", ltv: str = "ltv",
                thresholds: Sequence[float] = (0.3, 0.5, 0.7)) -> DataFrame:
    """Per threshold: clients flagged, churners among them, the money of these
    (kept if the campaign holds them) and that of the churners left out."""
    rows = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    r = scored.select((F.col(label) == 1).alias("y"), F.col(score).alias("s"), cents(F.coalesce(F.col(ltv), F.lit(0.0))).alias("c"),
                      rows.alias("threshold"))
    hit = F.col("s") >= F.col("threshold")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0)) / 100
    return r.groupBy("threshold").agg(
        F.count_if(hit).alias("n_flagged"), F.count_if(hit & F.col("y")).alias("n_caught"),
        total(hit & F.col("y")).alias("money_saved"), total(~hit & F.col("y")).alias("money_lost"))


def retention_roi(recs: DataFrame, tops: Sequence[int] = (10, 50, 100, 500), key: str = "client_id",
                  roi: str = "roi_estimate") -> DataFrame:
    """The summed return of the N clients with the highest one, for each N (a top-k report)."""
    best = recs.select(F.col(key).alias("k"), cents(F.col(roi)).alias("c"))
    best = best.orderBy(F.col("c").desc(), "k").limit(max(tops))
    # at most max(tops) rows
    rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "k"))).alias("rows"))
    each = rows.select("rows", F.explode(F.array(*[F.lit(n) for n in tops])).alias("top_n"))
    held = F.slice("rows", 1, F.col("top_n"))
    return each.select("top_n", F.size(held).alias("n_clients"),
                       (-F.aggregate(held, F.lit(0).cast("long"), lambda a, s: a + s["c"]) / 100).alias("roi"))


def budget_plan(offers: DataFrame, budget: int, key: str = "client_id", cost: str = "cost", value: str = "value") -> DataFrame:
    """``(key, cost, value, pass)`` of the clients a budget pays for; cost, value and budget are
    whole cents, and offers of no value or cost are left out.

    Clients come in the order of value per cost, then key. Pass 1 takes them
    while their running cost is within the budget; pass 2 spends what is left
    in the same way on later clients who cost no more than that."""
    rows = offers.select(F.col(key).alias("k"), F.col(cost).cast("long").alias("cost"), F.col(value).cast("long").alias("value"))
    rows = cut_lineage(rows, "offers").where("cost > 0 AND value > 0")
    order = F.struct((-(F.col("value") / F.col("cost"))).alias("r"), F.col("k"))
    ranked = cut_lineage(prefix_sums(rows.withColumn("__order", order), [], "__order", ["cost"]), "ranked-offers")
    first = ranked.where(F.col("cum_cost") <= budget)
    left = budget - (first.agg(F.max("cum_cost")).first()[0] or 0)
    rest = ranked.where((F.col("cum_cost") > budget) & (F.col("cost") <= left)).drop("cum_cost")
    second = prefix_sums(cut_lineage(rest, "cheaper-offers"), [], "__order", ["cost"]).where(F.col("cum_cost") <= left)
    return (first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))
            .select(F.col("k").alias(key), "cost", "value", "pass"))

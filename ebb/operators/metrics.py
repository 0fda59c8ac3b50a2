"""Classifier metrics on a scored frame.

Inputs are ``(label, score)`` rows, optionally with a ``model`` column so many
models are evaluated in one pass. Rows are first collapsed to counts per
distinct score (one partial-aggregated shuffle) and written once; the ROC's
cumulative counts come from :func:`prefix_sums` (ranges instead of one global
window), so a curve over billions of scores never sits in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cumulative import prefix_sums
from ..session import cut_lineage


def _by(df: DataFrame, by: Sequence[str] | None) -> list[str]:
    return list(by) if by is not None else (["model"] if "model" in df.columns else [])


def score_counts(df: DataFrame, label: str = "label", score: str = "score",
                 by: Sequence[str] | None = None) -> DataFrame:
    by = _by(df, by)
    y = F.col(label).cast("int") == 1
    return cut_lineage(df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")), "score-counts")


def roc_points(df: DataFrame, label: str = "label", score: str = "score",
               by: Sequence[str] | None = None) -> DataFrame:
    """``(threshold, fps, tps, fpr, tpr)`` per distinct score, highest first,
    plus the starting point at threshold ``+inf``. Every distinct threshold is
    kept (collinear points are not dropped)."""
    by = _by(df, by)
    return _curve(score_counts(df, label, score, by), by).drop("P", "N")


def _curve(c: DataFrame, by: list[str]) -> DataFrame:
    """The ROC of score counts, with the class sizes P and N."""
    cum = prefix_sums(c, by, "score", ["pos", "neg"], descending=True)
    tot = c.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pts = cum.select(*by, F.col("score").alias("threshold"), F.col("cum_neg").alias("fps"),
                     F.col("cum_pos").alias("tps"))
    start = tot.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("fps"),
                       F.lit(0).cast("long").alias("tps"))
    if by:
        allp = pts.unionByName(start).join(F.broadcast(tot), by)
    else:  # one-row totals as scalar subqueries rather than a join
        allp = pts.unionByName(start).withColumns({"P": tot.select("P").scalar(),
                                                   "N": tot.select("N").scalar()})
    return allp.select(*by, "threshold", "fps", "tps", "P", "N",
                       F.when(F.col("N") > 0, F.col("fps") / F.col("N")).otherwise(F.lit(float("nan"))).alias("fpr"),
                       F.when(F.col("P") > 0, F.col("tps") / F.col("P")).otherwise(F.lit(float("nan"))).alias("tpr"))


def auc(df: DataFrame, label: str = "label", score: str = "score",
        by: Sequence[str] | None = None) -> DataFrame:
    """Area under the ROC curve by the rank sum (ties count half).

    ``AUC = (sum over positives of average rank - P(P+1)/2) / (P*N)``, summed
    exactly in ``DECIMAL(38,0)`` as ``pos * (2*below + count + 1)``.
    """
    by = _by(df, by)
    c = score_counts(df, label, score, by).withColumn("cnt", F.col("pos") + F.col("neg"))
    cum = prefix_sums(c, by, "score", ["cnt"])
    below = F.col("cum_cnt") - F.col("cnt")
    term = (F.col("pos").cast("decimal(38,0)")
            * (F.lit(2) * below + F.col("cnt") + F.lit(1)).cast("decimal(38,0)"))
    s = cum.groupBy(*by).agg(F.sum(term).alias("s2"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    num = F.col("s2").cast("double") / 2.0 - F.col("P").cast("double") * (F.col("P") + 1) / 2.0
    return s.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                num / (F.col("P").cast("double") * F.col("N"))).alias("auc"))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                           by: Sequence[str] | None = None) -> DataFrame:
    """Precision, recall, F1, accuracy at the given predictions, 4 decimals;
    0 where a denominator is 0."""
    by = _by(df, by)
    y, p = F.col(label).cast("int") == 1, F.col(pred).cast("int") == 1
    g = df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                            F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return g.select(*by, "tp", "fp", "fn", "tn",
                    F.bround(ratio(tp, tp + fp), 4).alias("precision"),
                    F.bround(ratio(tp, tp + fn), 4).alias("recall"),
                    F.bround(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
                    F.bround(ratio(tp + tn, tp + tn + fp + fn), 4).alias("accuracy"))


def optimal_threshold(df: DataFrame, label: str = "label", score: str = "score",
                      cost_fp: float = 1.0, cost_fn: float = 3.0,
                      by: Sequence[str] | None = None) -> DataFrame:
    """The ROC threshold with the least ``fp*cost_fp + fn*cost_fn``
    (predicting positive at ``score >= threshold``); ties go to the highest
    threshold, which may be ``+inf``."""
    by = _by(df, by)
    r = _curve(score_counts(df, label, score, by), by)
    cost = F.col("fps") * cost_fp + (F.col("P") - F.col("tps")) * cost_fn
    best = r.groupBy(*by).agg(F.min_by(F.struct(F.col("threshold"), cost.alias("cost")),
                                       F.struct(cost.alias("c"), (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(*by, F.col("b.threshold").alias("threshold"), F.col("b.cost").alias("cost"))


def best_model(metrics: DataFrame, names: Sequence[str], metric: str = "auc_roc") -> DataFrame:
    """The model with the highest metric (4 decimals); ties go to the
    first name in ``names``."""
    order = F.lit(len(names))
    for i, n in reversed(list(enumerate(names))):
        order = F.when(F.col("model") == n, i).otherwise(order)
    return metrics.agg(F.max_by(F.struct("model", F.bround(metric, 4).alias("best_auc")),
                                F.struct(F.bround(metric, 4), -order)).alias("b")).select("b.*")

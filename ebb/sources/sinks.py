"""Sinks: predictions export, model persistence, report content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as FX
from ..functions.exprs import fixed_decimals


def export_predictions(recs: DataFrame, path: str, fmt: str = "csv") -> str:
    """The fixed export columns that are present, in order, with a header."""
    cols = [c for c in FX.EXPORT_COLUMNS if c in recs.columns]
    w = recs.select(*cols).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def save_model(model, path: str) -> str:
    """Spark ML persistence (fitted models) or the calibrated ensemble."""
    from pyspark.ml.util import MLWritable
    if isinstance(model, MLWritable):
        model.write().overwrite().save(path)
    else:
        model.write(path)
    return path


def _fill(template: str, **parts) -> F.Column:
    pieces, rest = [], template
    while "{" in rest:
        a, b = rest.index("{"), rest.index("}")
        pieces += [F.lit(rest[:a]), parts[rest[a + 1:b]]]
        rest = rest[b + 1:]
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


def report_lines(kpi: DataFrame, stats: DataFrame, recs: DataFrame, best: DataFrame | None = None,
                 top: int = 10) -> DataFrame:
    """Report content as ``(section, ord, line)`` rows.

    Totals from the KPI row, the best model (``model``, ``best_auc``) when
    given, a line per segment in table order, and the first ``top`` clients of
    the priority order (a top-k).
    """
    pct = lambda c: F.concat(fixed_decimals(c * 100, 1), F.lit("%"))
    totals = kpi.select(F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), _fill(FX.REPORT_TOTAL, n=F.format_number("total_clients", 0)).alias("line")),
        F.struct(F.lit(1).alias("ord"), _fill(FX.REPORT_CHURN, pct1=pct(F.col("churn_rate"))).alias("line")),
    )).alias("l")).select(F.lit("totals").alias("section"), "l.ord", "l.line")
    parts = [totals]
    if best is not None:
        parts.append(best.select(F.lit("totals").alias("section"), F.lit(2).alias("ord"),
                                 _fill(FX.REPORT_BEST, name=F.col("model"),
                                       auc3=fixed_decimals(F.col("best_auc"), 3)).alias("line")))
    parts.append(stats.select(
        F.lit("segments").alias("section"), F.col("segment_order").cast("int").alias("ord"),
        _fill(FX.REPORT_SEGMENT, seg=F.col("rfm_segment"), n=F.format_number("client_count", 0),
              pct1=F.concat(fixed_decimals(F.col("client_pct"), 1), F.lit("%"))).alias("line")))
    from pyspark.sql import Window

    from ..operators.actions import urgency_rank
    keys = [urgency_rank("alpha"), (F.col("ltv") * F.col("churn_prob")).desc(), F.col("client_id")]
    # top-k by a global ordered limit, then numbered over the k rows only
    ranked = recs.orderBy(*keys).limit(top).withColumn("i", F.row_number().over(Window.orderBy(*keys)))
    parts.append(ranked.select(F.lit("top_clients").alias("section"), F.col("i").cast("int").alias("ord"),
                               _fill(FX.REPORT_TOP, i=F.col("i").cast("string"),
                                     cid=F.col("client_id").cast("string"), seg=F.col("rfm_segment"),
                                     pct1=pct(F.col("churn_prob"))).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Automatic repair (F1-F5): dedupe, fill, winsorise.

Fit: from the health report (a row per column), plus one grouped exact-quantile
job for the medians and 1 %/99 % quantiles of the numeric columns that need
them, and one distributed mode job for the other columns. Apply: one
projection.

Modes are computed as value counts per ``(column, value)`` followed by a
``min_by`` per column, both with partial aggregation, instead of Spark's
``mode`` aggregate that keeps every distinct value of a column in one task.

Quirk fix: the reference clips the series taken before the fill, which brings
the filled nulls back; here the clip applies to the filled value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.quantiles import DEFAULT_ACCURACY
from ..session import cut_lineage
from .profile import HealthReport, _clean, iqr_quartiles, profile_dataframe


def column_modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column (smallest on ties), as strings."""
    if not cols:
        return {}
    long = (df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _clean(df, c).cast("string").alias("value"))
        for c in cols])).alias("kv")).select("kv.column", "kv.value")
        .where(F.col("value").isNotNull()))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("c")).alias("nc"), F.col("value"))).alias("mode"))
    got = {r["column"]: r["mode"] for r in best.collect()}
    return {c: got.get(c) for c in cols}


def drop_duplicate_rows(df: DataFrame, report: HealthReport) -> DataFrame:
    """rows equal on all columns once; written, as several jobs read them."""
    if report.table.select("duplicate_rows").first()[0] == 0:
        return df
    return cut_lineage(df.dropDuplicates(), "deduped")


def fit_repair(df: DataFrame, report: HealthReport,
               accuracy: int = DEFAULT_ACCURACY) -> dict:
    """Statistics for :func:`apply_repair` (a few values per column), from the
    rows as they are repaired (:func:`drop_duplicate_rows`)."""
    rows = report.columns.collect()
    numeric = {r["column"] for r in rows if r["numeric"]}
    fill_num = [r["column"] for r in rows if r["numeric"] and r["missing_pct"] > 0]
    clip = [r["column"] for r in rows if r["numeric"] and r["outlier_pct"] > X.OUTLIERS_MODERATE_PCT]
    fill_other = [r["column"] for r in rows if not r["numeric"] and r["missing_pct"] > 0]
    need_q = [c for c in df.columns if c in set(fill_num) | set(clip)]
    q = iqr_quartiles(df, need_q, probs=(X.WINSOR_LOW, 0.5, X.WINSOR_HIGH), accuracy=accuracy)
    modes = column_modes(df, fill_other)
    return {"numeric": numeric,
            "median": {c: (q[c][1] if q.get(c) else None) for c in fill_num},
            "clip": {c: (q[c][0], q[c][2]) for c in clip if q.get(c)},
            "mode": {c: modes.get(c) for c in fill_other}}


def apply_repair(df: DataFrame, fit: dict) -> DataFrame:
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        dt = df.schema[c].dataType
        if c in fit["numeric"] and (c in fit["median"] or c in fit["clip"]):
            # a numeric column with nulls or clipped values holds fractions
            # (pandas turns such columns to float): the result is double
            col = _clean(df, c).cast("double")
            dt = "double"
        if fit["median"].get(c) is not None:
            col = F.coalesce(col, F.lit(fit["median"][c]).cast(dt))
        elif c in fit["mode"]:
            m = fit["mode"][c]
            if m is None:
                # no value at all: the fixed UNKNOWN; other types have no such value and stay null
                col = F.coalesce(col, F.lit(X.FILL_UNKNOWN)) if dt.simpleString() == "string" else col
            else:
                col = F.coalesce(col, F.lit(m).cast(dt))
        if c in fit["clip"]:
            lo, hi = fit["clip"][c]
            col = (F.when(col < F.lit(lo), F.lit(lo))
                    .when(col > F.lit(hi), F.lit(hi)).otherwise(col))
        out.append(col.alias(c))
    return df.select(*out)


def auto_fix_dataframe(df: DataFrame, report: HealthReport | None = None,
                       accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """F1 (dedupe when duplicates exist) -> F2/F3 fills -> F4 clip."""
    report = report or profile_dataframe(df, accuracy=accuracy)
    base = drop_duplicate_rows(df, report)
    return apply_repair(base, fit_repair(base, report, accuracy))

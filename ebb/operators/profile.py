"""Data-quality profile.

Jobs, whatever the table width:

1. one grouped exact-quantile job for the IQR quartiles of every numeric column
   (unpivoted ``(column, value)`` rows grouped by column; two numbers per
   column reach the driver);
2. one wide aggregation for nulls, non-null counts and fence counts of all
   columns (one row), and one of ``(column, value)`` rows for their exact distinct
   counts: the copies of a value meet before the shuffle, and no row is expanded
   to the width of the table. ``distinct="approx"`` takes HyperLogLog sketches in
   the wide aggregation instead;
3. one aggregation over all columns for duplicate rows (lazy).

The numbers of 1 and 2, a few per column, reach the driver once; report and
table summary are expressions on these rows, so using them again reads no data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import fixed as X
from ..functions.exprs import col, fixed_decimals, is_numeric_type
from ..functions.quantiles import DEFAULT_ACCURACY, quantiles


def fmt(template: str, **parts: Column) -> Column:
    """Fill ``{name}`` slots of a fixed message template with columns.

    ``pct0``/``pct1`` slots get a number with 0 / 1 decimals, others a string.
    """
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        a, b = rest.index("{"), rest.index("}")
        pieces.append(F.lit(rest[:a]))
        key = rest[a + 1:b]
        c = parts[key]
        if key == "pct0":
            c = fixed_decimals(c, 0)
        elif key == "pct1":
            c = fixed_decimals(c, 1)
        pieces.append(c.cast("string"))
        rest = rest[b + 1:]
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


def _clean(df: DataFrame, name: str) -> Column:
    """The column with NaN as null (pandas counts both as missing)."""
    c = F.col(f"`{name}`")
    dt = df.schema[name].dataType
    if isinstance(dt, (DoubleType, FloatType)):
        return F.when(~F.isnan(c), c)
    return c


@dataclass
class HealthReport:
    columns: DataFrame                  # one row per column
    table: DataFrame                    # one row
    fences: dict = field(default_factory=dict)   # column -> (q1, q3)


def iqr_quartiles(df: DataFrame, cols: list[str], probs=(0.25, 0.75),
                  accuracy: int = DEFAULT_ACCURACY) -> dict[str, list[float] | None]:
    """Exact quantiles of several numeric columns in one grouped job."""
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _clean(df, c).cast("double").alias("v"))
        for c in cols])).alias("kv")).select("kv.column", "kv.v")
    rows = quantiles(long, "v", list(probs), by=["column"], accuracy=accuracy,
                     broadcast_groups=True, empty_groups=False).collect()
    got = {r["column"]: r["edges"] for r in rows}
    return {c: got.get(c) for c in cols}


def profile_dataframe(df: DataFrame, distinct: str = "exact",
                      accuracy: int = DEFAULT_ACCURACY) -> HealthReport:
    cols = df.columns
    numeric = [c for c in cols if is_numeric_type(df.schema[c].dataType)]
    q = iqr_quartiles(df, numeric, accuracy=accuracy)
    fences = {}
    for c in numeric:
        e = q.get(c)
        if e is not None and e[1] - e[0] != 0:
            iqr = e[1] - e[0]
            fences[c] = (e[0] - X.IQR_FACTOR * iqr, e[1] + X.IQR_FACTOR * iqr)

    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        v = _clean(df, c)
        aggs += [F.count_if(v.isNull()).alias(f"m{i}"), F.count(v).alias(f"nn{i}")]
        if distinct == "approx":
            aggs.append(F.approx_count_distinct(v).alias(f"d{i}"))
        if c in fences:
            lo, hi = fences[c]
            aggs.append(F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias(f"o{i}"))
        else:
            aggs.append(F.lit(0).cast("long").alias(f"o{i}"))
    wide = df.agg(*aggs).first()
    n_distinct = {i: wide[f"d{i}"] for i in range(len(cols))} if distinct == "approx" else distinct_counts(df)
    long = df.sparkSession.createDataFrame(
        [(wide["n"], i, c, df.schema[c].dataType.simpleString(), c in numeric, wide[f"m{i}"], wide[f"nn{i}"],
          n_distinct.get(i, 0), wide[f"o{i}"]) for i, c in enumerate(cols)],
        "n long, ordinal int, column string, dtype string, numeric boolean, missing_count long, nonnull long, "
        "n_distinct long, outlier_count long")
    report = column_scores(long)
    return HealthReport(report, table_summary(df, report), fences)


def distinct_counts(df: DataFrame) -> dict[int, int]:
    """Exact distinct non-null values per column position."""
    def text(c):
        kind = df.schema[c].dataType
        v = _clean(df, c)
        if isinstance(kind, (DoubleType, FloatType)):
            v = v.cast("double") + F.lit(0.0)   # -0.0 is 0.0
        return F.hex(v) if kind.simpleString() == "binary" else v.cast("string")

    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), text(c).alias("v")) for i, c in enumerate(df.columns)])).alias("r")) \
        .select("r.i", "r.v").where(F.col("v").isNotNull())
    return {r["i"]: r["n"] for r in values.groupBy("i", "v").agg(F.lit(1).alias("one"))
            .groupBy("i").agg(F.count("one").alias("n")).collect()}


def column_scores(long: DataFrame) -> DataFrame:
    """P1-P6 as expressions on rows ``(n, column, missing_count, nonnull, ...)``."""
    n = F.col("n")
    miss_pct = F.when(n > 0, F.col("missing_count") / n * 100).otherwise(F.lit(0.0))
    uniq_pct = F.when(F.col("nonnull") > 0,
                      F.col("n_distinct") / F.col("nonnull") * 100).otherwise(F.lit(0.0))
    out_pct = F.when(n > 0, F.col("outlier_count") / n * 100).otherwise(F.lit(0.0))
    r = long.select("ordinal", "column", "dtype", "numeric", "missing_count",
                    miss_pct.alias("missing_pct"), uniq_pct.alias("unique_pct"),
                    "n_distinct", "outlier_count", out_pct.alias("outlier_pct"))
    mp, op = F.col("missing_pct"), F.col("outlier_pct")
    issues = F.array_compact(F.array(
        F.when(mp > X.MISSING_CRITICAL_PCT, fmt(X.MSG_MISSING_CRITICAL, pct0=mp))
         .when(mp > X.MISSING_SIGNIFICANT_PCT, fmt(X.MSG_MISSING_SIGNIFICANT, pct1=mp)),
        # a constant column (one distinct value); see README on this fix
        F.when((F.col("n_distinct") == 1) & (mp < 100), F.lit(X.MSG_CONSTANT)),
        F.when(op > X.OUTLIERS_MANY_PCT, fmt(X.MSG_OUTLIERS_MANY, pct0=op))
         .when(op > X.OUTLIERS_MODERATE_PCT, fmt(X.MSG_OUTLIERS_MODERATE, pct1=op)),
    ))
    r = r.withColumn("issues", issues)
    raw = (F.lit(100.0) - F.least(mp * 2, F.lit(40.0)) - F.least(op * 2, F.lit(20.0))
           - F.when(F.size("issues") >= 3, 10).otherwise(0))
    return r.withColumn("score", F.greatest(F.lit(0), raw.cast("int")))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row ``(n, duplicate_rows)``; rows equal on all columns, nulls equal.

    Grouping by all columns combines copies map-side, so a row repeated a
    billion times is one partial-aggregate entry per partition.
    """
    # under internal names, so that the frame's columns may have any
    own = df.select(*[col(c).alias(f"__v{i}") for i, c in enumerate(df.columns)])
    g = own.groupBy(*own.columns).agg(F.count(F.lit(1)).alias("__copies"))
    return g.agg(F.coalesce(F.sum("__copies"), F.lit(0)).alias("n"),
                 F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_rows"))


def table_summary(df: DataFrame, report: DataFrame) -> DataFrame:
    """Overall score, global issues, duplicates (one row)."""
    dup = duplicate_rows(df)
    per_col = report.agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("missing_pct") > X.HIGH_MISSING_COLUMN_PCT,
                                               F.struct("ordinal", "column")))),
            lambda s: s["column"]), ", ").alias("high_missing"))
    # per_col is one row: its values enter as scalar subqueries (no join)
    t = dup.withColumns({c: per_col.select(c).scalar()
                         for c in ("total_columns", "avg_score", "high_missing")})
    dpct = F.when(F.col("n") > 0, F.col("duplicate_rows") / F.col("n") * 100).otherwise(F.lit(0.0))
    overall = F.when(F.col("total_columns") > 0, F.col("avg_score").cast("int")).otherwise(0)
    t = t.select(F.col("n").alias("total_rows"), "total_columns",
                 overall.alias("overall_score"), "duplicate_rows",
                 dpct.alias("duplicate_pct"), "high_missing")
    gi = F.array_compact(F.array(
        F.when(F.col("duplicate_rows") > 0,
               fmt(X.MSG_DUPLICATES, n=F.col("duplicate_rows"), pct1=F.col("duplicate_pct"))),
        F.when(F.col("overall_score") < X.SCORE_CRITICAL, F.lit(X.MSG_QUALITY_CRITICAL))
         .when(F.col("overall_score") < X.SCORE_MEDIUM, F.lit(X.MSG_QUALITY_MEDIUM)),
        F.when(F.col("high_missing") != "",
               fmt(X.MSG_HIGH_MISSING_COLUMNS, names=F.col("high_missing"))),
    ))
    return t.withColumn("global_issues", gi).drop("high_missing")

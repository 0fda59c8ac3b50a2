"""Distribution drift between a reference and a current sample.

Both samples are unpivoted to ``(feature, side, value)`` rows and every
statistic is grouped by feature, so the number of jobs does not grow with the
number of features:

The raw rows are aggregated once, to counts per ``(feature, value)`` and side;
PSI bins, KS running totals and the side sizes all start from that aggregate.

* PSI (D1): decile edges of the union per feature (exact grouped quantiles,
  bounded: 11 numbers per feature reach the driver), histogram counts by a
  bin-index expression on the value counts, empty bins filled from
  ``sequence``; the sum runs in bin order for a deterministic result.
* KS (D2): running totals of the value counts in value order by
  :func:`prefix_sums` (range buckets, no single-task window), ``max |F1-F2|``;
  the p-value is the asymptotic Kolmogorov series as a column expression (the
  reference's SciPy uses exact small-sample p-values; see README).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DoubleType, StringType, StructField,
                               StructType)

from ..functions import fixed as X
from ..functions.cumulative import prefix_sums
from ..functions.exprs import numeric_columns
from ..functions.quantiles import DEFAULT_ACCURACY, quantiles, weighted_quantiles
from ..session import cut_lineage

DRIFT_SCHEMA = StructType([
    StructField("feature", StringType()), StructField("psi", DoubleType()),
    StructField("ks_statistic", DoubleType()), StructField("ks_p_value", DoubleType()),
    StructField("drift_detected", BooleanType()), StructField("severity", StringType())])


def to_long(reference: DataFrame, current: DataFrame, cols: list[str]) -> DataFrame:
    """``(feature, side, value)`` rows; side 0 = reference, 1 = current; no nulls/NaN."""
    def side(df, s):
        return df.select(F.lit(s).alias("side"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"))
            for c in cols])).alias("kv")).select("kv.feature", "side", "kv.value")
    long = side(reference, 0).unionByName(side(current, 1))
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def kolmogorov_pvalue(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value ``Q_KS((sqrt(en) + .12 + .11/sqrt(en)) * D)``."""
    en = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (en + 0.12 + 0.11 / en) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.lit(2.0) * F.when(k % 2 == 1, 1.0).otherwise(-1.0)
        * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def value_counts(long: DataFrame) -> DataFrame:
    """``(feature, value, c0, c1)``: the one aggregation of the raw rows that
    PSI bins, KS running totals and the side sizes are all derived from."""
    return long.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == 0).alias("c0"), F.count_if(F.col("side") == 1).alias("c1"))


def side_sizes(vc: DataFrame) -> DataFrame:
    return vc.groupBy("feature").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))


def psi_by_feature(long: DataFrame, bins: int = X.PSI_BINS, eps: float = X.PSI_EPS,
                   accuracy: int = DEFAULT_ACCURACY, vc: DataFrame | None = None) -> DataFrame:
    """D1 per feature: ``(feature, psi)``; 0 for <2 distinct edges or an empty side."""
    probs = [i / bins for i in range(bins + 1)]
    vc = vc if vc is not None else cut_lineage(value_counts(long), "value-counts")
    both = vc.withColumn("c", F.col("c0") + F.col("c1"))
    edges = weighted_quantiles(both, "value", "c", probs, ["feature"]).collect()
    spark = long.sparkSession
    e_df = spark.createDataFrame(
        [(r["feature"], sorted(set(r["edges"]))) for r in edges if r["edges"]],
        "feature string, edges array<double>")
    sizes = side_sizes(vc)
    nb = F.size("edges") - 1
    binned = (vc.join(F.broadcast(e_df), "feature")
              .withColumn("bin", F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1, nb - 1)))
    counts = binned.groupBy("feature", "bin").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    grid = (e_df.where(F.size("edges") >= 2)
            .select("feature", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin")))
    t = grid.join(counts, ["feature", "bin"], "left").join(F.broadcast(sizes), "feature")
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(eps), x))
    # an empty side (n = 0) yields null here; the result is then 0 below
    e_pct = clip(F.try_divide(F.coalesce(F.col("c0"), F.lit(0)), F.col("n0")))
    a_pct = clip(F.try_divide(F.coalesce(F.col("c1"), F.lit(0)), F.col("n1")))
    t = t.withColumn("term", (a_pct - e_pct) * F.log(a_pct / e_pct))
    psi = t.groupBy("feature").agg(
        F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("bin", "term"))),
                                lambda s: s["term"]), F.lit(0.0), lambda a, x: a + x).alias("psi"))
    return sizes.join(psi, "feature", "left").select(
        "feature", F.when((F.col("n0") == 0) | (F.col("n1") == 0), F.lit(0.0))
        .otherwise(F.coalesce("psi", F.lit(0.0))).alias("psi"))


def ks_by_feature(long: DataFrame, vc: DataFrame | None = None) -> DataFrame:
    """D2 per feature: ``(feature, ks_statistic, ks_p_value, n0, n1)`` (unrounded)."""
    counts = vc if vc is not None else cut_lineage(value_counts(long), "value-counts")
    sizes = side_sizes(counts)
    cum = prefix_sums(counts, ["feature"], "value", ["c0", "c1"])
    d = (cum.join(F.broadcast(sizes), "feature")
         .groupBy("feature", "n0", "n1")
         .agg(F.max(F.abs(F.try_divide(F.col("cum_c0"), F.col("n0"))
                          - F.try_divide(F.col("cum_c1"), F.col("n1")))).alias("d")))
    return sizes.join(d.select("feature", "d"), "feature", "left").select(
        "feature", "n0", "n1",
        F.when((F.col("n0") == 0) | (F.col("n1") == 0), F.lit(0.0)).otherwise(F.col("d")).alias("ks_statistic"),
        F.when((F.col("n0") == 0) | (F.col("n1") == 0), F.lit(1.0))
         .otherwise(kolmogorov_pvalue(F.col("d"), F.col("n0").cast("double"),
                                      F.col("n1").cast("double"))).alias("ks_p_value"))


def detect_drift(reference: DataFrame, current: DataFrame, feature_cols: list[str] | None = None,
                 psi_threshold: float = X.PSI_THRESHOLD, alpha: float = X.KS_ALPHA,
                 accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """D3: a row per feature, PSI descending.

    Default features: numeric columns of ``reference`` also present in
    ``current``. With none, an empty DataFrame of the result schema.
    """
    if feature_cols is None:
        feature_cols = [c for c in numeric_columns(reference) if c in current.columns]
    if not feature_cols:
        return reference.sparkSession.createDataFrame([], DRIFT_SCHEMA)
    long = to_long(reference, current, feature_cols)
    names = reference.sparkSession.createDataFrame([(c, i) for i, c in enumerate(feature_cols)],
                                                   "feature string, ordinal int")
    vc = cut_lineage(value_counts(long), "value-counts")
    psi = psi_by_feature(long, accuracy=accuracy, vc=vc)
    ks = ks_by_feature(long, vc=vc)
    j = (F.broadcast(names).join(psi, "feature", "left").join(ks, "feature", "left")
         .select("feature", "ordinal", F.coalesce("psi", F.lit(0.0)).alias("psi"),
                 F.coalesce("ks_statistic", F.lit(0.0)).alias("ks"),
                 F.coalesce("ks_p_value", F.lit(1.0)).alias("p")))
    return j.select(
        "feature",
        F.bround("psi", 4).alias("psi"),
        F.bround("ks", 4).alias("ks_statistic"),
        F.bround("p", 4).alias("ks_p_value"),
        ((F.col("psi") > psi_threshold) | (F.col("p") < alpha)).alias("drift_detected"),
        F.when(F.col("psi") >= X.PSI_SEVERE, "severe")
         .when(F.col("psi") >= psi_threshold, "moderate").otherwise("none").alias("severity"),
        "ordinal",
    ).orderBy(F.col("psi").desc(), "ordinal").drop("ordinal")


def drift_alerts(drift: DataFrame, ks_line: bool = True) -> DataFrame:
    """Alert lines ``(ord, alert)``; feature names in PSI order."""
    d = drift.where("drift_detected")

    def names(cond: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(cond, F.struct((-F.col("psi")).alias("k"), F.col("feature"))))),
            lambda s: s["feature"]), ", ")

    agg = d.agg(F.count(F.lit(1)).alias("n"),
                names(F.col("severity") == "severe").alias("severe"),
                names(F.col("severity") == "moderate").alias("moderate"),
                names(F.col("severity") == "none").alias("ks_only"))

    def line(template: str, col: str) -> Column:
        a, b = template.split("{names}")
        return F.concat(F.lit(a), F.col(col), F.lit(b))

    lines = F.when(F.col("n") == 0, F.array(F.lit(X.MSG_DRIFT_NONE))).otherwise(F.array_compact(F.array(
        F.when(F.col("severe") != "", line(X.MSG_DRIFT_SEVERE, "severe")),
        F.when(F.col("moderate") != "", line(X.MSG_DRIFT_MODERATE, "moderate")),
        *([F.when(F.col("ks_only") != "", line(X.MSG_DRIFT_KS_ONLY, "ks_only"))] if ks_line else []),
    )))
    return agg.select(F.posexplode(lines).alias("ord", "alert"))


def split_halves(df: DataFrame, key: str, accuracy: int = DEFAULT_ACCURACY) -> tuple[DataFrame, DataFrame]:
    """Rows up to the exact median of ``key`` vs the rest (Spark has no row
    order). A non-numeric key is split at the median of its ``xxhash64``; rows
    without a key are in the second half, so the halves hold all rows."""
    from ..functions.exprs import is_numeric_type
    k = F.col(key) if is_numeric_type(df.schema[key].dataType) else F.xxhash64(F.col(key))
    med = quantiles(df, k, [0.5], accuracy=accuracy).first()["edges"]
    cut = med[0] if med else None
    first = F.coalesce(k <= F.lit(cut), F.lit(False))
    return df.where(first), df.where(~first)

"""RFM segmentation.

Scores are quartile bins of recency, frequency and monetary value. The five
edges of all three metrics come from one grouped exact-quantile job over the
unpivoted ``(metric, value)`` rows (the fit step: 15 numbers reach the driver).
Scoring and the segment rule are then literal-edge column expressions in one
projection: no join and no shuffle of the client table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bin_by_edges, norm_name, order_rank, segment_rule
from ..functions.fixed import (FREQUENCY_CANDIDATES, FREQUENCY_HINTS, MONETARY_CANDIDATES,
                               MONETARY_HINTS, RECENCY_CANDIDATES, RECENCY_HINTS, SEGMENT_ORDER)
from ..functions.quantiles import DEFAULT_ACCURACY, quantiles

QUARTILE_PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]
DERIVED_RECENCY = "days_since_activity_date"


def detect_rfm_columns(columns: list[str]) -> tuple[str | None, str | None, str | None]:
    """Pick the recency, frequency and monetary columns by name.

    Candidate lists first, in list order; then a substring fallback. The
    frequency fallback is tried even when no recency column was found, and
    never picks the recency column itself.
    """
    by_norm = {norm_name(c): c for c in columns}

    def pick(cands, hints, exclude=None):
        for c in cands:
            if c in by_norm:
                return by_norm[c]
        for c in columns:
            low = c.lower()
            if any(h in low for h in hints) and by_norm.get(norm_name(c)) != exclude:
                return c
        return None

    r = pick(RECENCY_CANDIDATES, RECENCY_HINTS)
    f = pick(FREQUENCY_CANDIDATES, FREQUENCY_HINTS, exclude=r)
    m = pick(MONETARY_CANDIDATES, MONETARY_HINTS)
    return r, f, m


def compute_rfm(df: DataFrame, recency_col: str | None = None,
                frequency_col: str | None = None, monetary_col: str | None = None,
                accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Add ``r_score, f_score, m_score, rfm_score, rfm_segment``.

    Null policy (R2): recency <- its median, frequency and monetary <- 0.
    Without a recency column, recency is derived from ``activity_date`` as days
    before the latest activity date.
    """
    auto_r, auto_f, auto_m = detect_rfm_columns(df.columns)
    r_col = recency_col or auto_r
    f_col = frequency_col or auto_f
    m_col = monetary_col or auto_m
    if r_col is None and "activity_date" in df.columns:
        last = df.select(F.max("activity_date")).scalar()
        df = df.withColumn(DERIVED_RECENCY,
                           F.datediff(F.to_date(last), F.to_date("activity_date")).cast("long"))
        r_col = DERIVED_RECENCY
    for role, col, cands in (("Recency", r_col, RECENCY_CANDIDATES),
                             ("Frequency", f_col, FREQUENCY_CANDIDATES),
                             ("Monetary", m_col, MONETARY_CANDIDATES)):
        if col is None:
            raise ValueError(f"No {role} column found; expected one of {cands}")

    edges = rfm_edges(df, r_col, f_col, m_col, accuracy)
    return apply_rfm(df, r_col, f_col, m_col, edges)


def rfm_edges(df: DataFrame, r_col: str, f_col: str, m_col: str,
              accuracy: int = DEFAULT_ACCURACY) -> dict:
    """Fit step: the recency median and the five edges per metric.

    Two small jobs (median first, since it fills recency nulls; then the edges
    of all three metrics in one grouped quantile job). The result is a few
    numbers, so it is brought to the driver and applied as literals.
    """
    med = quantiles(df, r_col, [0.5], accuracy=accuracy).first()["edges"]
    median_r = med[0] if med else None
    filled = df.select(
        F.coalesce(F.col(r_col).cast("double"), F.lit(median_r).cast("double")).alias("r"),
        F.coalesce(F.col(f_col).cast("double"), F.lit(0.0)).alias("f"),
        F.coalesce(F.col(m_col).cast("double"), F.lit(0.0)).alias("m"))
    long = filled.select(F.expr("stack(3, 'r', r, 'f', f, 'm', m) AS (metric, v)"))
    rows = quantiles(long, "v", QUARTILE_PROBS, by=["metric"], accuracy=accuracy, broadcast_groups=True,
                     empty_groups=False).collect()
    out = {r["metric"]: r["edges"] for r in rows}
    out["median_r"] = median_r
    return out


def apply_rfm(df: DataFrame, r_col: str, f_col: str, m_col: str, edges: dict) -> DataFrame:
    """Transform step: scores, score string and segment in one projection."""
    def arr(k):
        e = edges.get(k)
        if e is None:  # no rows at all
            return F.lit(None).cast("array<double>")
        return F.array(*[F.lit(float(x)) for x in e])

    r_v = F.coalesce(F.col(r_col).cast("double"), F.lit(edges.get("median_r")).cast("double"))
    f_v = F.coalesce(F.col(f_col).cast("double"), F.lit(0.0))
    m_v = F.coalesce(F.col(m_col).cast("double"), F.lit(0.0))
    out = df.withColumns({
        "r_score": (F.lit(5) - bin_by_edges(r_v, arr("r"))).cast("int"),
        "f_score": bin_by_edges(f_v, arr("f")).cast("int"),
        "m_score": bin_by_edges(m_v, arr("m")).cast("int"),
    })
    return out.withColumns({
        "rfm_score": F.concat(F.col("r_score").cast("string"), F.col("f_score").cast("string"),
                              F.col("m_score").cast("string")),
        "rfm_segment": segment_rule(F.col("r_score"), F.col("f_score"), F.col("m_score")),
    })


def segment_stats(rfm: DataFrame, extras: bool = False) -> DataFrame:
    """Per segment count, mean scores and share of all clients (1 decimal).

    ``extras`` adds the mean recency and total value the reference's docstring
    promises (``avg_recency``, ``total_value``) when those columns are given.
    """
    aggs = [F.count("client_id").alias("client_count"),
            F.avg("r_score").alias("avg_r_score"),
            F.avg("f_score").alias("avg_f_score"),
            F.avg("m_score").alias("avg_m_score")]
    if extras:
        r, _, m = detect_rfm_columns(rfm.columns)
        if r:
            aggs.append(F.avg(r).alias("avg_recency"))
        if m:
            aggs.append(F.sum(m).alias("total_value"))
    g = rfm.groupBy("rfm_segment").agg(*aggs)
    # at most five rows: the total is a window over the aggregated frame
    total = F.sum("client_count").over(Window.partitionBy())
    return (g.withColumn("client_pct", F.bround(F.col("client_count") / total * 100, 1))
             .withColumn("segment_order", order_rank(F.col("rfm_segment"), SEGMENT_ORDER))
             .orderBy("segment_order", "rfm_segment"))


def rfm_pivot(rfm: DataFrame) -> DataFrame:
    """Client count (and churn mean when labelled) per (r, f, m) cell."""
    aggs = [F.count("client_id").alias("count")]
    if "churned" in rfm.columns:
        aggs.append(F.avg(F.col("churned").cast("double")).alias("avg_churn"))
    g = rfm.groupBy("r_score", "f_score", "m_score").agg(*aggs)
    return g.withColumn("segment", segment_rule(F.col("r_score"), F.col("f_score"),
                                                F.col("m_score")))


def rfm_headline(rfm: DataFrame) -> DataFrame:
    """One row of headline counts, shares and the churn rate."""
    n = F.count(F.lit(1))
    champ = F.count_if(F.col("rfm_segment") == "Champions")
    risk = F.count_if(F.col("rfm_segment") == "At Risk")
    aggs = [n.alias("total_clients"), champ.alias("champions"),
            F.bround(champ / n * 100, 1).alias("champions_pct"),
            risk.alias("at_risk"), F.bround(risk / n * 100, 1).alias("at_risk_pct")]
    if "churned" in rfm.columns:
        aggs.append(F.avg(F.col("churned").cast("double")).alias("churn_rate"))
    return rfm.agg(*aggs)

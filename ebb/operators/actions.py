"""Retention actions and dashboard queries.

The rule table is a handful of fixed rows, so it is applied as ``CASE``
expressions generated from :data:`SEGMENT_ACTIONS` (no join at all); scores and
segments arrive on the same rows, or are joined on ``client_id`` when they
come as separate frames. Everything is one projection plus, for the ordered
output, a global sort (range-partitioned by Spark, so it scales).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.exprs import norm_name


def _rule(seg: Column, idx: int) -> Column:
    """Field ``idx`` of the segment's rule; unknown segments take the Lost rule."""
    expr = F.lit(X.SEGMENT_ACTIONS["Lost"][idx])
    for name, rule in reversed(list(X.SEGMENT_ACTIONS.items())):
        expr = F.when(seg == name, F.lit(rule[idx])).otherwise(expr)
    return expr


def ltv_column(columns: list[str]) -> str | None:
    """A2: first LTV source column present (normalised name match)."""
    by_norm = {norm_name(c): c for c in columns}
    for cand in X.LTV_COLUMNS:
        if norm_name(cand) in by_norm:
            return by_norm[norm_name(cand)]
    return None


def risk_level(p: Column, threshold: float) -> Column:
    """A1."""
    return (F.when(p >= threshold, "high").when(p >= X.MEDIUM_RISK_FLOOR, "medium")
            .otherwise("low"))


def urgency_rank(order: str) -> Column:
    """Sort key of ``urgency``: ``alpha`` as the reference sorts it (critical,
    high, low, medium, none), or ``severity`` (critical, high, medium, low, none)."""
    u = F.col("urgency")
    if order == "alpha":
        return u
    return (F.when(u == "critical", 0).when(u == "high", 1).when(u == "medium", 2)
            .when(u == "low", 3).otherwise(4))


def generate_recommendations(rfm: DataFrame, probs: DataFrame | None = None,
                             prob_col: str = "churn_prob", churn_threshold: float = 0.7,
                             order: str = "alpha", sort: bool = True) -> DataFrame:
    """One row per client with action, channel, tone, offer, urgency, ROI.

    ``probs`` (``client_id``, ``prob_col``) is joined on ``client_id`` when the
    probabilities are not already a column of ``rfm``. Sorted by urgency, then
    ``ltv * churn_prob`` descending, then ``client_id``.
    """
    if probs is not None:
        rfm = rfm.join(probs.select("client_id", prob_col), "client_id")
    ltv_src = ltv_column(rfm.columns)
    ltv = (F.coalesce(F.col(ltv_src).cast("double"), F.lit(0.0)) if ltv_src
           else F.lit(X.LTV_DEFAULT))
    p = F.col(prob_col).cast("double")
    seg = F.col("rfm_segment")
    base = rfm.select("client_id", "rfm_segment", p.alias("churn_prob"),
                      risk_level(p, churn_threshold).alias("churn_risk_level"), ltv.alias("ltv"))
    seg, risk = F.col("rfm_segment"), F.col("churn_risk_level")
    escalated = seg.isin(*X.ESCALATED_SEGMENTS)
    high_esc, med_esc = escalated & (risk == "high"), escalated & (risk == "medium")
    action = _rule(seg, 1)
    lift = _rule(seg, 6)
    lift = (F.when(risk == "high", lift * X.HIGH_RISK_LIFT_FACTOR)
            .when(risk == "low", lift * X.LOW_RISK_LIFT_FACTOR).otherwise(lift))
    out = base.select(
        "client_id", "rfm_segment", "churn_prob", "churn_risk_level", "ltv",
        F.when(high_esc, F.concat(F.lit(X.URGENT_PREFIX), action))
         .when(med_esc, F.concat(F.lit(X.WARNING_PREFIX), action)).otherwise(action).alias("action"),
        F.when(high_esc, F.lit(X.URGENT_CHANNEL)).otherwise(_rule(seg, 2)).alias("channel"),
        _rule(seg, 3).alias("tone"),
        _rule(seg, 5).alias("offer"),
        F.when(high_esc, F.lit("critical")).when(med_esc, F.lit("high"))
         .otherwise(_rule(seg, 4)).alias("urgency"),
        F.bround(F.col("ltv") * (F.lit(1.0) - lift) * F.col("churn_prob"), 2).alias("roi_estimate"),
    )
    if sort:
        out = out.orderBy(urgency_rank(order), (F.col("ltv") * F.col("churn_prob")).desc(), "client_id")
    return out


def sort_key(order: str = "alpha") -> Column:
    """The A6 priority order as one comparable struct (smaller first)."""
    return F.struct(urgency_rank(order).alias("u"),
                    (-(F.col("ltv") * F.col("churn_prob"))).alias("v"), F.col("client_id"))


def money_sum(c: Column, scale: int = 2) -> Column:
    """Sum of money in ``DECIMAL(38, scale)``: exact and independent of the
    order partitions are combined in, then back to double."""
    return F.sum(c.cast(f"decimal(38,{scale})")).cast("double")


def kpi_row(recs: DataFrame, money_scale: int = 2) -> DataFrame:
    """Money at risk (sum of LTV at high risk), mean probability, mean LTV, count."""
    return recs.agg(
        F.coalesce(money_sum(F.when(F.col("churn_risk_level") == "high", F.col("ltv")), money_scale),
                   F.lit(0.0)).alias("money_at_risk"),
        F.avg("churn_prob").alias("churn_rate"),
        (money_sum(F.col("ltv"), money_scale) / F.count(F.lit(1))).alias("avg_ltv"),
        F.count(F.lit(1)).alias("total_clients"))


def probability_by_segment(recs: DataFrame) -> DataFrame:
    """A10."""
    return recs.groupBy("rfm_segment").agg(F.avg("churn_prob").alias("churn_prob"))


def top_at_risk(recs: DataFrame, n: int = 10, order: str = "alpha") -> DataFrame:
    """First ``n`` clients in priority order (a top-k: the limit is the feature)."""
    return (recs.orderBy(urgency_rank(order), (F.col("ltv") * F.col("churn_prob")).desc(), "client_id")
            .limit(n).select("client_id", "rfm_segment", "churn_prob", "ltv", "action"))


CARD_SEGMENTS = ["At Risk", "Hibernating", "Loyal", "Champions"]


def segment_cards(recs: DataFrame, order: str = "alpha", money_scale: int = 2) -> DataFrame:
    """Per segment (not Lost): count, sum LTV, mean probability, and the
    action, channel and ROI of its first client in priority order."""
    first = F.min_by(F.struct("action", "channel", "roi_estimate"), sort_key(order))
    g = (recs.where(F.col("rfm_segment").isin(*CARD_SEGMENTS))
         .groupBy("rfm_segment")
         .agg(F.count(F.lit(1)).alias("n_clients"), money_sum(F.col("ltv"), money_scale).alias("money"),
              F.avg("churn_prob").alias("avg_prob"), first.alias("first")))
    rank = F.lit(len(CARD_SEGMENTS))
    for i, s in reversed(list(enumerate(CARD_SEGMENTS))):
        rank = F.when(F.col("rfm_segment") == s, i).otherwise(rank)
    return g.select("rfm_segment", "n_clients", "money", "avg_prob",
                    F.col("first.action").alias("action"), F.col("first.channel").alias("channel"),
                    F.col("first.roi_estimate").alias("roi_estimate"),
                    rank.alias("card_order")).orderBy("card_order")


def factor_advice(factors: DataFrame, top_n: int = 3, key: str = "client_id") -> DataFrame:
    """Per ``key``, up to ``top_n`` distinct advice texts for its factors.

    ``factors``: ``(key, rank, feature)``, ``rank`` giving the factor order.
    For each factor the first advice key contained in its normalised name wins.
    The advice table is fixed (21 rows) and applied as expressions.
    """
    name = F.lower(F.regexp_replace(F.col("feature"), " ", "_"))
    pos = F.lit(None).cast("int")
    for i, (k, _) in reversed(list(enumerate(X.FACTOR_ADVICE))):
        pos = F.when(F.instr(name, k) > 0, F.lit(i)).otherwise(pos)
    texts = F.array(*[F.lit(t) for _, t in X.FACTOR_ADVICE])
    # guard: element_at of a literal array at a null index yields its last element
    hit = factors.select(key, "rank", F.when(pos.isNotNull(), F.element_at(texts, pos + 1))
                         .alias("advice")).where(
        F.col("advice").isNotNull())
    # first occurrence of each advice, in factor order, then the first top_n
    firsts = hit.groupBy(key, "advice").agg(F.min("rank").alias("rank"))
    return firsts.groupBy(key).agg(F.slice(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "advice"))), lambda s: s["advice"]),
        1, top_n).alias("advice"))


def _template(template: str, parts: dict[str, Column]) -> Column:
    """Fill ``{name}`` slots of a fixed template with string columns."""
    pieces, rest = [], template
    while "{" in rest:
        a, b = rest.index("{"), rest.index("}")
        pieces += [F.lit(rest[:a]), parts[rest[a + 1:b]]]
        rest = rest[b + 1:]
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


def executive_summary(stats: DataFrame, kpi: DataFrame, auc: DataFrame, top_factor: DataFrame) -> DataFrame:
    """One row ``summary`` from the segment stats (R8), the KPI row (A9),
    a one-row ``auc`` frame and a one-row ``feature`` frame (top factor)."""
    from ..functions.exprs import fixed_decimals
    seg = stats.agg(
        F.coalesce(F.sum(F.when(F.col("rfm_segment") == "At Risk", F.col("client_count"))), F.lit(0)).alias("at_risk"),
        F.coalesce(F.sum(F.when(F.col("rfm_segment") == "Hibernating", F.col("client_count"))), F.lit(0))
        .alias("hibernating"))
    top = top_factor.agg(F.first("feature").alias("top_factor"))
    # every input is one row: they meet as scalar subqueries, not joins
    j = kpi.withColumns({"at_risk": seg.select("at_risk").scalar(),
                         "hibernating": seg.select("hibernating").scalar(),
                         "auc": auc.agg(F.first("auc")).scalar(),
                         "top_factor": top.select("top_factor").scalar()})
    parts = {
        "total_clients": F.format_number(F.col("total_clients"), 0),
        "churn_rate": F.concat(fixed_decimals(F.col("churn_rate") * 100, 1), F.lit("%")),
        "money_at_risk": F.format_number(F.col("money_at_risk"), 0),
        "auc": fixed_decimals(F.col("auc"), 2),
        "at_risk": F.col("at_risk").cast("string"),
        "hibernating": F.col("hibernating").cast("string"),
        "top_factor": F.coalesce(F.col("top_factor"), F.lit("N/A")),
    }
    return j.select(_template(X.EXECUTIVE_SUMMARY, parts).alias("summary"))

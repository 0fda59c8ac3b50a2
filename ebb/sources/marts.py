"""Client marts: one row per client, derived from the order and event tables.

The reference takes a ready client table; here it is built by Spark from the
star schema, so every downstream operator's work grows with the source tables.

``client_mart`` (one row per customer):

* ``cutoff = max(o_orderdate) - 365 days``; features come only from orders on
  or before the cutoff, ``churned = 1`` when the client has no order after it
  (no label leakage).
* Customers without an order before the cutoff keep their row with null
  features (plain left-join semantics): the profiling, repair and RFM null
  policies act on these.

Plan, and why it holds at scale:

* ``orders`` is read once and aggregated per customer with conditional
  aggregates (before / after the cutoff in the same pass). The cutoff is a
  scalar subquery, so the whole mart is one lazy plan.
* ``lineitem`` joins ``orders`` (filtered to the cutoff) on the order key and
  ``part`` on the part key. No broadcast is forced on these growing tables:
  the planner and AQE broadcast ``part`` only below
  ``spark.sql.autoBroadcastJoinThreshold`` and fall back to a sort-merge join
  with skew splitting above it.
* Distinct part types are counted in two hash aggregations,
  ``(client, type)`` then ``client``, each with a map-side partial step, so a
  client holding a third of all lines is combined before any shuffle.
* ``nation``/``region`` have a fixed size (25 / 5 rows) and are broadcast.
* Money is summed as ``DECIMAL(18,2)`` (the prices have two decimals), which is
  exact and independent of summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

MART_COLUMNS = [
    "client_id", "activity_date", "days_since_last_order", "total_orders",
    "total_revenue", "avg_order_value", "return_rate", "product_categories_used",
    "discount_usage_pct", "tenure_months", "account_balance", "mktsegment",
    "region", "churned",
]


def order_cutoff(orders: DataFrame, horizon_days: int = 365) -> Column:
    """Scalar-subquery column: ``max(o_orderdate) - horizon_days``."""
    return orders.select(
        (F.max("o_orderdate") - F.make_interval(days=F.lit(horizon_days))).alias("cutoff")
    ).scalar()


def client_mart(spark: SparkSession, sf_dir: str, horizon_days: int = 365) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey",
                        "o_totalprice", "o_orderdate")
    cutoff = order_cutoff(orders, horizon_days)
    before = F.col("o_orderdate") <= cutoff

    per_order_client = orders.groupBy("o_custkey").agg(
        F.count_if(before).alias("n_before"),
        F.sum(F.when(before, F.col("o_totalprice").cast("decimal(18,2)"))).alias("revenue"),
        F.max(F.when(before, F.col("o_orderdate"))).alias("last_order"),
        F.min(F.when(before, F.col("o_orderdate"))).alias("first_order"),
        F.count_if(~before).alias("n_after"),
    )

    early = orders.where(before).select("o_orderkey", "o_custkey")
    lines = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey",
                       "l_discount", "l_returnflag")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_type")
    by_type = (lines.join(early, F.col("l_orderkey") == F.col("o_orderkey"))
               .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
               .groupBy("o_custkey", "p_type")
               .agg(F.count(F.lit(1)).alias("n_lines"),
                    F.count_if(F.col("l_returnflag") == "R").alias("n_returns"),
                    F.sum(F.col("l_discount").cast("decimal(18,2)")).alias("disc")))
    per_line_client = by_type.groupBy("o_custkey").agg(
        F.count("p_type").alias("n_types"),
        F.sum("n_lines").alias("n_lines"),
        F.sum("n_returns").alias("n_returns"),
        F.sum("disc").alias("disc"))

    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey",
                          "c_acctbal", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    geo = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))

    has_hist = F.col("n_before") > 0
    revenue = F.col("revenue").cast("double")
    cutoff_date = F.to_date(cutoff)
    j = (customer
         .join(per_order_client, F.col("c_custkey") == F.col("o_custkey"), "left")
         .join(per_line_client, "o_custkey", "left")
         .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    return j.select(
        F.col("c_custkey").alias("client_id"),
        F.to_date("last_order").alias("activity_date"),
        F.datediff(cutoff_date, F.to_date("last_order")).cast("long").alias("days_since_last_order"),
        F.when(has_hist, F.col("n_before")).alias("total_orders"),
        F.when(has_hist, revenue).alias("total_revenue"),
        F.when(has_hist, revenue / F.col("n_before")).alias("avg_order_value"),
        (F.col("n_returns") / F.col("n_lines")).alias("return_rate"),
        F.col("n_types").alias("product_categories_used"),
        (F.col("disc").cast("double") / F.col("n_lines")).alias("discount_usage_pct"),
        F.floor(F.datediff(cutoff_date, F.to_date("first_order")) / 30).cast("long")
         .alias("tenure_months"),
        F.col("c_acctbal").alias("account_balance"),
        F.col("c_mktsegment").alias("mktsegment"),
        F.col("r_name").alias("region"),
        F.when(F.coalesce(F.col("n_after"), F.lit(0)) > 0, 0).otherwise(1).alias("churned"),
    )


CLIENT_MART_SQL = """
WITH cut AS (SELECT max(o_orderdate) - INTERVAL 365 DAY AS cutoff FROM orders),
oc AS (
  SELECT o_custkey,
         count(*) FILTER (WHERE o_orderdate <= cutoff) AS n_before,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderdate <= cutoff) AS revenue,
         max(o_orderdate) FILTER (WHERE o_orderdate <= cutoff) AS last_order,
         min(o_orderdate) FILTER (WHERE o_orderdate <= cutoff) AS first_order,
         count(*) FILTER (WHERE o_orderdate > cutoff) AS n_after
  FROM orders, cut GROUP BY o_custkey),
bt AS (
  SELECT o.o_custkey, p.p_type, count(*) AS n_lines,
         count(*) FILTER (WHERE l.l_returnflag = 'R') AS n_returns,
         sum(CAST(l.l_discount AS DECIMAL(18,2))) AS disc
  FROM lineitem l
  JOIN (SELECT o_orderkey, o_custkey FROM orders, cut WHERE o_orderdate <= cutoff) o
    ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY o.o_custkey, p.p_type),
lc AS (
  SELECT o_custkey, count(p_type) AS n_types, sum(n_lines) AS n_lines,
         sum(n_returns) AS n_returns, sum(disc) AS disc
  FROM bt GROUP BY o_custkey)
SELECT c.c_custkey AS client_id,
       CAST(oc.last_order AS DATE) AS activity_date,
       CAST(date_diff('day', CAST(oc.last_order AS DATE), CAST(cut.cutoff AS DATE)) AS BIGINT) AS days_since_last_order,
       CASE WHEN oc.n_before > 0 THEN oc.n_before END AS total_orders,
       CASE WHEN oc.n_before > 0 THEN CAST(oc.revenue AS DOUBLE) END AS total_revenue,
       CASE WHEN oc.n_before > 0 THEN CAST(oc.revenue AS DOUBLE) / oc.n_before END AS avg_order_value,
       CAST(lc.n_returns AS DOUBLE) / lc.n_lines AS return_rate,
       lc.n_types AS product_categories_used,
       CAST(lc.disc AS DOUBLE) / lc.n_lines AS discount_usage_pct,
       CAST(floor(date_diff('day', CAST(oc.first_order AS DATE), CAST(cut.cutoff AS DATE)) / 30) AS BIGINT) AS tenure_months,
       c.c_acctbal AS account_balance,
       c.c_mktsegment AS mktsegment,
       r.r_name AS region,
       CASE WHEN coalesce(oc.n_after, 0) > 0 THEN 0 ELSE 1 END AS churned
FROM customer c
CROSS JOIN cut
LEFT JOIN oc ON c.c_custkey = oc.o_custkey
LEFT JOIN lc ON oc.o_custkey = lc.o_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def events_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ``user_id`` from the event log.

    Recency is measured from the last event in the whole log; churned = no
    event in the final 7 days. Features are taken from the events before that
    window only. One aggregation over ``events`` with conditional aggregates.
    """
    ev = read_table(spark, sf_dir, "events", "user_id", "ts", "event_type", "value")
    end = ev.select(F.max("ts").alias("m")).scalar()
    label_start = end - F.make_interval(days=F.lit(7))
    early = F.col("ts") < label_start
    agg = ev.groupBy("user_id").agg(
        F.max(F.when(early, F.col("ts"))).alias("last_ts"),
        F.count_if(early).alias("n_events"),
        F.count_if(early & (F.col("event_type") == "purchase")).alias("n_purchases"),
        F.count_if(early & (F.col("event_type") == "error")).alias("n_errors"),
        F.sum(F.when(early & (F.col("event_type") == "purchase"),
                     F.col("value").cast("decimal(18,2)"))).alias("spent"),
        F.count_if(~early).alias("n_late"),
    )
    return agg.select(
        F.col("user_id").alias("client_id"),
        F.to_date("last_ts").alias("activity_date"),
        F.datediff(F.to_date(label_start), F.to_date("last_ts")).cast("long").alias("days_since_last_activity"),
        F.when(F.col("n_events") > 0, F.col("n_events")).alias("transaction_count"),
        F.col("n_purchases").alias("total_orders"),
        F.col("n_errors").alias("support_tickets_last_30d"),
        F.coalesce(F.col("spent").cast("double"), F.lit(0.0)).alias("total_revenue"),
        F.when(F.col("n_late") > 0, 0).otherwise(1).alias("churned"),
    )


EVENTS_MART_SQL = """
WITH b AS (SELECT max(ts) - INTERVAL 7 DAY AS label_start FROM events),
a AS (
  SELECT user_id,
         max(ts) FILTER (WHERE ts < label_start) AS last_ts,
         count(*) FILTER (WHERE ts < label_start) AS n_events,
         count(*) FILTER (WHERE ts < label_start AND event_type = 'purchase') AS n_purchases,
         count(*) FILTER (WHERE ts < label_start AND event_type = 'error') AS n_errors,
         sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE ts < label_start AND event_type = 'purchase') AS spent,
         count(*) FILTER (WHERE ts >= label_start) AS n_late
  FROM events, b GROUP BY user_id)
SELECT user_id AS client_id,
       CAST(last_ts AS DATE) AS activity_date,
       CAST(date_diff('day', CAST(last_ts AS DATE), CAST(b.label_start AS DATE)) AS BIGINT) AS days_since_last_activity,
       CASE WHEN n_events > 0 THEN n_events END AS transaction_count,
       n_purchases AS total_orders,
       n_errors AS support_tickets_last_30d,
       coalesce(CAST(spent AS DOUBLE), 0.0) AS total_revenue,
       CASE WHEN n_late > 0 THEN 0 ELSE 1 END AS churned
FROM a, b
"""

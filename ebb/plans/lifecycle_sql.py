"""DuckDB twins of the queries in :mod:`.lifecycle`."""

from __future__ import annotations

import itertools
import math

from ..operators.lifecycle import HORIZONS
from .sqltext import QP, sql_bin, sql_segment, with_mart

_DAYS = """days AS (SELECT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS p, count(*) AS n,
  coalesce(sum(CAST(value AS DECIMAL(18,4))), 0) AS v FROM events
  WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
ends AS (SELECT min(p) AS a, max(p) AS z FROM days)"""


def _labels_cte(lookback: int = 30, step: int = 7) -> str:
    labels = ",\n".join(f"CASE WHEN s + {h} <= z THEN CAST(coalesce(min(p) FILTER (p > s) > s + {h}, true) AS INTEGER) END"
                        f" AS churn_{h}" for h in HORIZONS)
    return f"""{_DAYS},
snaps AS (SELECT z - i * {step} AS s, z FROM ends, generate_series(0, (z - a) // {step}) t(i)),
labels AS (
  SELECT user_id, DATE '1970-01-01' + CAST(s AS INTEGER) AS snapshot, CAST(sum(n) FILTER (p <= s) AS BIGINT) AS n_events,
    count(*) FILTER (p <= s) AS active_days, CAST(sum(v) FILTER (p <= s) AS DOUBLE) AS value_sum,
    s - max(p) FILTER (p <= s) AS days_since_last,
    {labels}
  FROM snaps JOIN days ON p > s - {lookback} AND p <= s + {max(HORIZONS)}
  GROUP BY user_id, s, z HAVING count(*) FILTER (p <= s) > 0)"""


def horizon_labels_sql() -> str:
    return f"WITH {_labels_cte()} SELECT * FROM labels"


def horizon_rates_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT {h} AS horizon, count(churn_{h}) AS n_labelled, CAST(coalesce(sum(churn_{h}), 0) AS BIGINT) AS n_churned,"
        f" CASE WHEN count(churn_{h}) > 0 THEN CAST(sum(churn_{h}) AS DOUBLE) / count(churn_{h}) END AS churn_rate FROM labels"
        for h in HORIZONS)
    return f"WITH {_labels_cte()} {parts}"


def lag_trend_sql(period: int = 7, lags=(1, 2, 4), trend: int = 4) -> str:
    lag_cols = ",\n".join(f"lag(n, {k}) OVER c AS n_lag_{k}, CAST(lag(v, {k}) OVER c AS DOUBLE) AS value_lag_{k}" for k in lags)
    return f"""WITH {_DAYS},
counts AS (SELECT user_id, p // {period} AS q, CAST(sum(n) AS BIGINT) AS n, sum(v) AS v FROM days GROUP BY ALL),
grid AS (SELECT user_id, unnest(generate_series(min(q), (SELECT max(q) FROM counts))) AS q FROM counts GROUP BY user_id),
panel AS (SELECT user_id, q, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM grid LEFT JOIN counts USING (user_id, q)),
rows AS (SELECT user_id, DATE '1970-01-01' + CAST(q * {period} AS INTEGER) AS period, n, CAST(v AS DOUBLE) AS value,
  {lag_cols},
  CASE WHEN count(*) OVER t > 1 THEN
    CAST(count(*) OVER t * sum(q * n) OVER t - sum(q) OVER t * sum(n) OVER t AS DOUBLE)
    / CAST(count(*) OVER t * sum(q * q) OVER t - sum(q) OVER t * sum(q) OVER t AS DOUBLE) END AS trend
  FROM panel WINDOW c AS (PARTITION BY user_id ORDER BY q),
    t AS (PARTITION BY user_id ORDER BY q ROWS BETWEEN {trend - 1} PRECEDING AND CURRENT ROW))
SELECT *, CASE WHEN trend > 0 THEN 'rising' WHEN trend < 0 THEN 'falling' WHEN trend = 0 THEN 'flat' END AS direction FROM rows"""


def _segments_ctes(window: int = 12) -> str:
    return f"""
months AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS p, count(*) AS n,
  sum(CAST(o_totalprice AS DECIMAL(18,4))) AS v FROM orders GROUP BY ALL),
cal AS (SELECT unnest(generate_series(min(p), max(p))) AS mo FROM months),
state AS (SELECT o_custkey, mo, CAST(mo - max(p) AS DOUBLE) AS r, CAST(sum(n) AS DOUBLE) AS f, CAST(sum(v) AS DOUBLE) AS m
  FROM cal JOIN months ON p <= mo AND p > mo - {window} GROUP BY o_custkey, mo),
edges AS (SELECT mo, quantile_cont(r, {QP}) AS er, quantile_cont(f, {QP}) AS ef, quantile_cont(m, {QP}) AS em FROM state GROUP BY mo),
scores AS (SELECT o_custkey, mo, 5 - {sql_bin('r', 'er')} AS rs, {sql_bin('f', 'ef')} AS fs, {sql_bin('m', 'em')} AS ms
  FROM state JOIN edges USING (mo)),
segs AS (SELECT o_custkey, mo, {sql_segment('rs', 'fs', 'ms')} AS segment FROM scores)"""


def monthly_segments_sql() -> str:
    return f"""WITH {_segments_ctes()}
SELECT o_custkey, make_date(mo // 12, mo % 12 + 1, 1) AS month, segment FROM segs"""


def segment_transitions_sql() -> str:
    return f"""WITH {_segments_ctes()},
moves AS (
  SELECT coalesce(b.mo, a.mo + 1) AS mo, coalesce(a.segment, 'absent') AS from_segment, coalesce(b.segment, 'absent') AS to_segment
  FROM segs a FULL JOIN segs b ON a.o_custkey = b.o_custkey AND a.mo + 1 = b.mo),
g AS (SELECT mo, from_segment, to_segment, count(*) AS clients FROM moves
  WHERE mo > (SELECT min(mo) FROM segs) AND mo <= (SELECT max(mo) FROM segs) GROUP BY ALL)
SELECT make_date(mo // 12, mo % 12 + 1, 1) AS month, from_segment, to_segment, clients,
       CAST(clients AS DOUBLE) / sum(clients) OVER (PARTITION BY mo, from_segment) AS share FROM g"""


#: Whole-numbered measures of a client, so that both engines add the same doubles.
SMOTE_VECTOR = ["CAST(coalesce(days_since_last_order, 0) AS DOUBLE)", "CAST(coalesce(total_orders, 0) * 50 AS DOUBLE)",
                "CAST(coalesce(product_categories_used, 0) * 20 AS DOUBLE)", "CAST(coalesce(tenure_months, 0) * 10 AS DOUBLE)"]


def _neighbour_ctes(k: int) -> str:
    d2 = " + ".join(f"(a.f{i} - b.f{i}) * (a.f{i} - b.f{i})" for i in range(len(SMOTE_VECTOR)))
    cols = ", ".join(f"{e} AS f{i}" for i, e in enumerate(SMOTE_VECTOR))
    return f"""
counts AS (SELECT count(*) FILTER (churned = 1) AS pos, count(*) FILTER (churned <> 1) AS neg FROM mart),
small AS (SELECT client_id, {cols} FROM mart, counts WHERE churned = CASE WHEN pos <= neg THEN 1 ELSE 0 END),
near AS (SELECT a.client_id, CAST(row_number() OVER (PARTITION BY a.client_id ORDER BY {d2}, b.client_id) AS INTEGER) AS rank,
  b.client_id AS neighbour, sqrt({d2}) AS distance FROM small a JOIN small b ON a.client_id <> b.client_id
  QUALIFY rank <= {k})"""


def smote_neighbours_sql(k: int = 5) -> str:
    return with_mart("client", _neighbour_ctes(k) + "\nSELECT * FROM near")


def smote_rows_sql(k: int = 5, seed: int = 42) -> str:
    h = "md5(client_id || '|' || draw || '|' || '" + str(seed) + "')"
    cols = ", ".join(f"a.f{i} + d.gap * (b.f{i} - a.f{i}) AS f{i}" for i in range(len(SMOTE_VECTOR)))
    return with_mart("client", _neighbour_ctes(k) + f""",
ranked AS (SELECT client_id, row_number() OVER (ORDER BY md5(client_id || '|{seed}'), client_id) AS pos,
  count(*) OVER () AS n FROM small),
shares AS (SELECT client_id, abs(pos_n - neg_n) // n + CASE WHEN pos <= abs(pos_n - neg_n) % n THEN 1 ELSE 0 END AS share
  FROM ranked, (SELECT pos AS pos_n, neg AS neg_n FROM counts)),
draws AS (SELECT client_id, CAST(unnest(generate_series(1, share)) AS INTEGER) AS draw FROM shares WHERE share > 0),
drawn AS (SELECT client_id, draw, ('0x' || substr({h}, 1, 8))::BIGINT AS pick, ('0x' || substr({h}, 9, 8))::BIGINT / 4294967296.0 AS gap FROM draws),
d AS (SELECT drawn.client_id, draw, gap, neighbour FROM drawn
  JOIN (SELECT client_id, max(rank) AS ranks FROM near GROUP BY client_id) r USING (client_id)
  JOIN near ON near.client_id = drawn.client_id AND near.rank = pick % ranks + 1)
SELECT d.client_id, d.draw, d.neighbour, d.gap, {cols} FROM d
JOIN small a ON a.client_id = d.client_id JOIN small b ON b.client_id = d.neighbour""")


#: Two fixed trees over columns of the mart: (column number, threshold, left, right), leaves (value, cover).
TREE_COLUMNS = ["days_since_last_order", "total_orders", "return_rate"]
RULE_TREES = [
    (0, 90, (1, 5, (0.2, 30), (-0.1, 50)), (1, 8, (2, 0.3, (0.5, 20), (0.9, 5)), (0, 400, (0.1, 25), (0.7, 10)))),
    (2, 0.25, (0.05, 60), (0, 200, (1, 6, (0.3, 7), (-0.2, 9)), (0.6, 24))),
]


def _cover(node) -> float:
    return node[1] if len(node) == 2 else _cover(node[2]) + _cover(node[3])


def _value_given(node, known: frozenset) -> str:
    """SQL of a tree's mean when only the ``known`` columns are known."""
    if len(node) == 2:
        return repr(float(node[0]))
    f, threshold, left, right = node
    a, b = _value_given(left, known), _value_given(right, known)
    if f in known:
        return f"(CASE WHEN x{f} <= {float(threshold)!r} THEN {a} ELSE {b} END)"
    return f"({float(_cover(left))!r} * {a} + {float(_cover(right))!r} * {b}) / {float(_cover(node))!r}"


def explain_tree_sql() -> str:
    """Attributions by enumeration of all subsets of the columns."""
    m, rows = len(TREE_COLUMNS), []
    for i, name in enumerate(TREE_COLUMNS):
        others = [j for j in range(m) if j != i]
        terms = []
        for size in range(m):
            weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
            for s in map(frozenset, itertools.combinations(others, size)):
                terms += [f"{weight!r} * ({_value_given(t, s | {i})} - {_value_given(t, s)})" for t in RULE_TREES]
        rows.append(f"SELECT client_id, {i} AS ordinal, '{name}' AS feature, round({' + '.join(terms)}, 9) AS contribution FROM x")
    cols = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS x{i}" for i, c in enumerate(TREE_COLUMNS))
    return with_mart("client", f"x AS (SELECT client_id, {cols} FROM mart)\n" + " UNION ALL ".join(rows))


def fallback_importance_sql(coefficients: dict[str, float]) -> str:
    rows = ", ".join(f"('{f}', {abs(float(w))!r})" for f, w in coefficients.items())
    return f"""SELECT feature, round(importance, 6) AS importance, 'importances' AS method, 0.5 AS base_value,
       (SELECT count(*) FROM customer) * {len(coefficients)} AS n_contributions, 0.0 AS largest
FROM (VALUES {rows}) t(feature, importance)"""


def explain_tree_checks_sql(models: list[str]) -> str:
    rows = ", ".join(f"('{m}')" for m in models)
    return f"""SELECT model, (SELECT count(*) FROM customer) AS n_clients, 0 AS n_off, 'tree' AS method
FROM (VALUES {rows}) t(model)"""


# --- campaigns, clusters, dictionaries, CSV files ------------------------------------

BUDGET = 500_000          # cents
#: Cost in cents and value in cents of an offer, in both engines' SQL.
OFFER_COST = "CAST(floor(ltv) AS BIGINT) % 2000 + 500"
OFFER_VALUE = "CAST(round(CAST(roi_estimate AS DECIMAL(28,6)) * 100) AS BIGINT)"


def lift_top_decile_sql() -> str:
    from .sqltext import scored_mart_cte
    return scored_mart_cte() + """,
g AS (SELECT score, count(*) AS cnt, count(*) FILTER (WHERE label = 1) AS pos FROM s GROUP BY score),
r AS (SELECT *, sum(cnt) OVER (ORDER BY score DESC) - cnt AS before, sum(cnt) OVER () AS n, sum(pos) OVER () AS p FROM g),
i AS (SELECT *, least(greatest(0.1::DOUBLE * n - before, 0.0), CAST(cnt AS DOUBLE)) AS inside FROM r),
t AS (SELECT CAST(any_value(n) AS BIGINT) AS n_rows, CAST(any_value(p) AS BIGINT) AS n_positive,
  coalesce(sum(pos) FILTER (inside = cnt), 0) + coalesce(max(pos * inside / cnt) FILTER (inside > 0 AND inside < cnt), 0.0) AS top_positive FROM i)
SELECT *, (top_positive / (0.1::DOUBLE * n_rows)) / (CAST(n_positive AS DOUBLE) / n_rows) AS lift FROM t"""


def money_saved_sql() -> str:
    from .sqltext import recs_ctes
    return recs_ctes() + """,
c AS (SELECT mart.churned = 1 AS y, churn_prob AS s, CAST(round(CAST(ltv AS DECIMAL(28,6)) * 100) AS BIGINT) AS c,
             unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS threshold FROM recs JOIN mart USING (client_id))
SELECT threshold, count(*) FILTER (s >= threshold) AS n_flagged, count(*) FILTER (s >= threshold AND y) AS n_caught,
  CAST(coalesce(sum(c) FILTER (s >= threshold AND y), 0) AS DOUBLE) / 100 AS money_saved,
  CAST(coalesce(sum(c) FILTER (s < threshold AND y), 0) AS DOUBLE) / 100 AS money_lost FROM c GROUP BY threshold"""


def retention_roi_sql() -> str:
    from .sqltext import recs_ctes
    return recs_ctes() + f""",
o AS (SELECT {OFFER_VALUE} AS c, row_number() OVER (ORDER BY {OFFER_VALUE} DESC, client_id) AS pos FROM recs)
SELECT top_n, CAST(count(*) AS INTEGER) AS n_clients, CAST(sum(c) AS DOUBLE) / 100 AS roi
FROM (SELECT unnest([10, 50, 100, 500]) AS top_n) JOIN o ON pos <= top_n GROUP BY top_n"""


def budget_plan_sql() -> str:
    from .sqltext import recs_ctes
    return recs_ctes() + f""",
offers AS (SELECT client_id, {OFFER_COST} AS cost, {OFFER_VALUE} AS value FROM recs),
ranked AS (SELECT *, sum(cost) OVER (ORDER BY value / cost DESC, client_id) AS cum FROM offers WHERE cost > 0 AND value > 0),
spent AS (SELECT {BUDGET} - coalesce(max(cum) FILTER (cum <= {BUDGET}), 0) AS rest FROM ranked),
later AS (SELECT ranked.*, rest, sum(cost) OVER (ORDER BY value / cost DESC, client_id) AS cum2 FROM ranked, spent
          WHERE cum > {BUDGET} AND cost <= rest)
SELECT client_id, cost, value, 1 AS pass FROM ranked WHERE cum <= {BUDGET}
UNION ALL SELECT client_id, cost, value, 2 FROM later WHERE cum2 <= rest"""


KMEANS_START = [[0.0, 100.0, 100.0, 100.0], [100.0, 500.0, 300.0, 300.0], [300.0, 800.0, 500.0, 500.0], [800.0, 50.0, 20.0, 200.0]]
KMEANS_ROUNDS = 5


def kmeans_sql() -> str:
    m, k = len(SMOTE_VECTOR), len(KMEANS_START)
    cols = ", ".join(f"{e} AS f{i}" for i, e in enumerate(SMOTE_VECTOR))
    d2 = " + ".join(f"(f{i} - c{i}) * (f{i} - c{i})" for i in range(m))
    start = ", ".join("(" + ", ".join([str(j), *map(repr, c)]) + ")" for j, c in enumerate(KMEANS_START))
    names = ", ".join(f"c{i}" for i in range(m))
    out = [f"x AS (SELECT client_id, {cols} FROM mart)", f"k0 AS (SELECT * FROM (VALUES {start}) t(cluster, {names}))"]
    for r in range(KMEANS_ROUNDS + 1):
        out.append(f"""a{r} AS (SELECT client_id, {', '.join(f'f{i}' for i in range(m))}, cluster, {d2} AS d2 FROM x, k{r}
  QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY {d2}, cluster) = 1)""")
        if r < KMEANS_ROUNDS:
            means = ", ".join(f"coalesce(s.c{i}, k{r}.c{i}) AS c{i}" for i in range(m))
            sums = ", ".join(f"sum(f{i}) / count(*) AS c{i}" for i in range(m))
            out.append(f"k{r + 1} AS (SELECT cluster, {means} FROM k{r} LEFT JOIN "
                       f"(SELECT cluster, {sums} FROM a{r} GROUP BY cluster) s USING (cluster))")
    assert k
    return with_mart("client", ",\n".join(out) + f"\nSELECT client_id, cluster, sqrt(d2) AS distance FROM a{KMEANS_ROUNDS}")


SEGMENT_NAMES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
#: Damaged segment names, by the key.
DAMAGED_SEGMENT = ("CASE WHEN c_custkey % 13 = 0 THEN substr(c_mktsegment, 2) WHEN c_custkey % 13 = 1 THEN c_mktsegment || 'XX' "
                   "WHEN c_custkey % 13 = 2 THEN lower(c_mktsegment) WHEN c_custkey % 13 = 3 THEN 'x' || substr(c_mktsegment, 2) "
                   "WHEN c_custkey % 13 = 4 THEN NULL WHEN c_custkey % 13 = 5 THEN '' ELSE c_mktsegment END")


def dictionary_sql() -> str:
    entries = ", ".join(f"('{s}')" for s in SEGMENT_NAMES)
    return f"""WITH v AS (SELECT {DAMAGED_SEGMENT} AS value FROM customer),
e AS (SELECT * FROM (VALUES {entries}) t(entry)),
odd AS (SELECT value, count(*) AS n_rows FROM v WHERE value IS NOT NULL AND value NOT IN (SELECT entry FROM e) GROUP BY value),
near AS (SELECT value, entry, CAST(levenshtein(value, entry) AS INTEGER) AS edits FROM odd, e
  WHERE levenshtein(value, entry) <= 2 QUALIFY row_number() OVER (PARTITION BY value ORDER BY levenshtein(value, entry), entry) = 1)
SELECT value, n_rows, entry AS nearest, edits FROM odd LEFT JOIN near USING (value)"""


#: A text column whose values hold line breaks, quotes and delimiters.
NOTE = "CASE WHEN client_id % 7 = 0 THEN concat('two', chr(10), 'lines; \"quoted\", ', mktsegment) WHEN client_id % 7 = 1 THEN 'a;b,c' ELSE mktsegment END"
ACCENTED = "concat(mktsegment, chr(228), chr(233), chr(223))"


def csv_text_sql(column: str) -> str:
    return with_mart("client", f"dummy AS (SELECT 1)\nSELECT client_id, {column} AS note, churned FROM mart")

"""SQL twins of the operators, as text for the DuckDB oracle.

Each function returns SQL over the pre-registered table views. The SQL states
the same semantics as the Spark operator independently (``quantile_cont`` for
linear quantiles, ``CASE`` chains for rules), so a match is a real check.
"""

from __future__ import annotations

from ..functions.fixed import SEGMENT_ORDER
from ..sources.marts import CLIENT_MART_SQL, EVENTS_MART_SQL

MARTS = {"client": CLIENT_MART_SQL, "events": EVENTS_MART_SQL}
RFM_COLS = {"client": ("days_since_last_order", "total_orders", "total_revenue"),
            "events": ("days_since_last_activity", "total_orders", "total_revenue")}


def with_mart(mart: str, body: str) -> str:
    return f"WITH mart AS ({MARTS[mart]}),\n{body}"


def sql_bin(v: str, e: str) -> str:
    inner = lambda a, b, c: (f"(1 + CAST({v} > {a} AS INTEGER) + CAST({v} > {b} AS INTEGER)"
                             f" + CAST({v} > {c} AS INTEGER))")
    step = f"(({e}[5] - {e}[1]) / 4.0)"
    return (f"CASE WHEN len(list_distinct({e})) = 5 THEN {inner(f'{e}[2]', f'{e}[3]', f'{e}[4]')}"
            f" WHEN {e}[1] = {e}[5] THEN 2"
            f" ELSE {inner(f'1 * {step} + {e}[1]', f'2 * {step} + {e}[1]', f'3 * {step} + {e}[1]')} END")


def sql_segment(r: str, f: str, m: str) -> str:
    return (f"CASE WHEN {r} = 4 AND {f} = 4 AND {m} >= 3 THEN 'Champions'"
            f" WHEN {r} <= 2 AND {f} >= 3 AND {m} >= 3 THEN 'At Risk'"
            f" WHEN {r} = 1 AND {f} = 1 AND {m} <= 2 THEN 'Lost'"
            f" WHEN {r} <= 2 AND {f} <= 2 THEN 'Hibernating'"
            f" WHEN {r} >= 3 AND {f} >= 2 AND {m} >= 2 THEN 'Loyal'"
            f" WHEN {r} <= 2 THEN 'Hibernating' ELSE 'Loyal' END")


def sql_order_rank(col: str, order=SEGMENT_ORDER) -> str:
    parts = " ".join(f"WHEN {col} = '{s}' THEN {i}" for i, s in enumerate(order))
    return f"CASE {parts} ELSE 99 END"


QP = "[0.0, 0.25, 0.5, 0.75, 1.0]"


def rfm_ctes(mart: str) -> str:
    """CTEs ``mart``, ``rfm`` (mart columns + scores + segment)."""
    r, f, m = RFM_COLS[mart]
    return with_mart(mart, f"""
med AS (SELECT quantile_cont(CAST({r} AS DOUBLE), 0.5) AS med FROM mart),
filled AS (
  SELECT mart.*, coalesce(CAST({r} AS DOUBLE), med.med) AS _r,
         coalesce(CAST({f} AS DOUBLE), 0.0) AS _f, coalesce(CAST({m} AS DOUBLE), 0.0) AS _m
  FROM mart, med),
e AS (SELECT quantile_cont(_r, {QP}) AS er, quantile_cont(_f, {QP}) AS ef,
             quantile_cont(_m, {QP}) AS em FROM filled),
scored AS (
  SELECT filled.*, CAST(5 - {sql_bin('_r', 'er')} AS INTEGER) AS r_score,
         CAST({sql_bin('_f', 'ef')} AS INTEGER) AS f_score,
         CAST({sql_bin('_m', 'em')} AS INTEGER) AS m_score
  FROM filled, e),
rfm AS (
  SELECT scored.* EXCLUDE (_r, _f, _m),
         CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_score,
         {sql_segment('r_score', 'f_score', 'm_score')} AS rfm_segment
  FROM scored)""")


def rfm_scores_sql(mart: str) -> str:
    return rfm_ctes(mart) + """
SELECT client_id, r_score, f_score, m_score, rfm_score, rfm_segment FROM rfm"""


def segment_stats_sql(mart: str) -> str:
    return rfm_ctes(mart) + f""",
g AS (SELECT rfm_segment, count(client_id) AS client_count, avg(r_score) AS avg_r_score,
             avg(f_score) AS avg_f_score, avg(m_score) AS avg_m_score
      FROM rfm GROUP BY rfm_segment)
SELECT rfm_segment, client_count, avg_r_score, avg_f_score, avg_m_score,
       round_even(client_count / sum(client_count) OVER () * 100, 1) AS client_pct,
       {sql_order_rank('rfm_segment')} AS segment_order
FROM g"""


def rfm_pivot_sql(mart: str) -> str:
    return rfm_ctes(mart) + f"""
SELECT r_score, f_score, m_score, count(client_id) AS count,
       avg(CAST(churned AS DOUBLE)) AS avg_churn,
       {sql_segment('r_score', 'f_score', 'm_score')} AS segment
FROM rfm GROUP BY r_score, f_score, m_score"""


def rfm_headline_sql(mart: str) -> str:
    return rfm_ctes(mart) + """
SELECT count(*) AS total_clients,
       count(*) FILTER (WHERE rfm_segment = 'Champions') AS champions,
       round_even(count(*) FILTER (WHERE rfm_segment = 'Champions') / count(*) * 100, 1) AS champions_pct,
       count(*) FILTER (WHERE rfm_segment = 'At Risk') AS at_risk,
       round_even(count(*) FILTER (WHERE rfm_segment = 'At Risk') / count(*) * 100, 1) AS at_risk_pct,
       avg(CAST(churned AS DOUBLE)) AS churn_rate
FROM rfm"""


# --- profile / repair --------------------------------------------------------

MART_SCHEMA = [("client_id", "bigint", True), ("activity_date", "date", False),
               ("days_since_last_order", "bigint", True), ("total_orders", "bigint", True),
               ("total_revenue", "double", True), ("avg_order_value", "double", True),
               ("return_rate", "double", True), ("product_categories_used", "bigint", True),
               ("discount_usage_pct", "double", True), ("tenure_months", "bigint", True),
               ("account_balance", "double", True), ("mktsegment", "string", False),
               ("region", "string", False), ("churned", "int", True)]
EVENTS_SCHEMA = [("event_id", "bigint", True), ("ts", "timestamp_ntz", False),
                 ("user_id", "bigint", True), ("event_type", "string", False),
                 ("value", "double", True), ("props", "string", False)]
LINEITEM_SCHEMA = [("l_orderkey", "bigint", True), ("l_partkey", "bigint", True),
                   ("l_suppkey", "bigint", True), ("l_linenumber", "int", True),
                   ("l_quantity", "double", True), ("l_extendedprice", "double", True),
                   ("l_discount", "double", True), ("l_tax", "double", True),
                   ("l_returnflag", "string", False), ("l_linestatus", "string", False),
                   ("l_shipdate", "timestamp_ntz", False)]


#: The mart with damage by the key; the same expressions hold in both engines.
DIRTY_COLUMNS = {
    "client_id": "client_id",
    "balance": "CASE WHEN client_id % 3 = 0 THEN NULL ELSE account_balance END",
    "order_value": "CASE WHEN client_id % 10 = 0 THEN NULL ELSE avg_order_value END",
    "spikes": "CASE WHEN client_id % 8 = 0 THEN CAST(1000 + client_id AS DOUBLE) ELSE CAST(client_id % 7 AS DOUBLE) END",
    "bumps": "CASE WHEN client_id % 16 = 0 THEN CAST(500 + client_id AS DOUBLE) ELSE CAST(client_id % 7 AS DOUBLE) END",
    "one_value": "CAST('same' AS STRING)",
    "empty": "CAST(NULL AS STRING)",
    "segment": "CASE WHEN client_id % 4 = 0 THEN NULL ELSE mktsegment END",
    "day": "CASE WHEN client_id % 6 = 0 THEN NULL ELSE activity_date END",
}
DIRTY_SCHEMA = [("client_id", "bigint", True), ("balance", "double", True), ("order_value", "double", True),
                ("spikes", "double", True), ("bumps", "double", True), ("one_value", "string", False),
                ("empty", "string", False), ("segment", "string", False), ("day", "date", False)]
_DIRTY = f"SELECT {', '.join(f'{e} AS {c}' for c, e in DIRTY_COLUMNS.items())} FROM ({CLIENT_MART_SQL})"
DIRTY_SQL = f"SELECT * FROM ({_DIRTY}) UNION ALL SELECT * FROM ({_DIRTY}) WHERE client_id % 5 = 0"


def _msg(template: str, **parts: str) -> str:
    out, rest = [], template
    while "{" in rest:
        a, b = rest.index("{"), rest.index("}")
        out.append("'" + rest[:a].replace("'", "''") + "'")
        key = rest[a + 1:b]
        if key == "pct0":
            out.append(f"printf('%.0f', {parts[key]})")
        elif key == "pct1":
            out.append(f"printf('%.1f', {parts[key]})")
        else:
            out.append(f"CAST({parts[key]} AS VARCHAR)")
        rest = rest[b + 1:]
    out.append("'" + rest.replace("'", "''") + "'")
    return " || ".join(out)


def profile_ctes(src: str, schema) -> str:
    """CTEs ``src``, ``fences``, ``colstats``, ``colrep`` for a table SQL."""
    from ..functions import fixed as X
    num = [c for c, _, isnum in schema if isnum]
    qs = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.75]) AS q_{c}" for c in num)
    blocks = []
    for i, (c, dt, isnum) in enumerate(schema):
        if isnum:
            out = (f"count(*) FILTER (WHERE q_{c}[2] - q_{c}[1] <> 0 AND "
                   f"(CAST({c} AS DOUBLE) < q_{c}[1] - 1.5 * (q_{c}[2] - q_{c}[1]) OR "
                   f"CAST({c} AS DOUBLE) > q_{c}[2] + 1.5 * (q_{c}[2] - q_{c}[1])))")
        else:
            out = "0"
        blocks.append(
            f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{dt}' AS dtype, {str(isnum).upper()} AS numeric,"
            f" count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS missing_count,"
            f" count({c}) AS nonnull, count(DISTINCT {c}) AS n_distinct,"
            f" CAST({out} AS BIGINT) AS outlier_count FROM src, fences")
    mp, op = "missing_pct", "outlier_pct"
    issues = (f"list_filter([CASE WHEN {mp} > {X.MISSING_CRITICAL_PCT} THEN {_msg(X.MSG_MISSING_CRITICAL, pct0=mp)}"
              f" WHEN {mp} > {X.MISSING_SIGNIFICANT_PCT} THEN {_msg(X.MSG_MISSING_SIGNIFICANT, pct1=mp)} END,"
              f" CASE WHEN n_distinct = 1 AND {mp} < 100 THEN {_msg(X.MSG_CONSTANT)} END,"
              f" CASE WHEN {op} > {X.OUTLIERS_MANY_PCT} THEN {_msg(X.MSG_OUTLIERS_MANY, pct0=op)}"
              f" WHEN {op} > {X.OUTLIERS_MODERATE_PCT} THEN {_msg(X.MSG_OUTLIERS_MODERATE, pct1=op)} END],"
              f" lambda x: x IS NOT NULL)")
    return f"""WITH src AS ({src}),
fences AS (SELECT {qs} FROM src),
colstats AS ({' UNION ALL '.join(blocks)}),
pcts AS (
  SELECT ordinal, "column", dtype, numeric, missing_count, n_distinct, outlier_count, n,
         CASE WHEN n > 0 THEN missing_count / n * 100 ELSE 0.0 END AS missing_pct,
         CASE WHEN nonnull > 0 THEN n_distinct / nonnull * 100 ELSE 0.0 END AS unique_pct,
         CASE WHEN n > 0 THEN outlier_count / n * 100 ELSE 0.0 END AS outlier_pct
  FROM colstats),
withissues AS (SELECT pcts.*, {issues} AS issues FROM pcts),
colrep AS (
  SELECT withissues.*, CAST(greatest(0, trunc(100.0 - least(missing_pct * 2, 40.0)
           - least(outlier_pct * 2, 20.0) - CASE WHEN len(issues) >= 3 THEN 10 ELSE 0 END)) AS INTEGER) AS score
  FROM withissues)"""


def profile_columns_sql(src: str, schema) -> str:
    return profile_ctes(src, schema) + """
SELECT ordinal, "column", dtype, missing_count, missing_pct, unique_pct, n_distinct,
       outlier_count, outlier_pct, array_to_string(issues, '; ') AS issues, score
FROM colrep"""


def profile_table_sql(src: str, schema) -> str:
    from ..functions import fixed as X
    cols = ", ".join(c for c, _, _ in schema)
    return profile_ctes(src, schema) + f""",
dup AS (SELECT coalesce(sum(c), 0) AS n, coalesce(sum(c - 1), 0) AS duplicate_rows
        FROM (SELECT count(*) AS c FROM src GROUP BY {cols})),
pc AS (SELECT count(*) AS total_columns, coalesce(avg(score), 0.0) AS avg_score,
              coalesce(string_agg("column", ', ' ORDER BY ordinal) FILTER (WHERE missing_pct > {X.HIGH_MISSING_COLUMN_PCT}), '') AS high_missing
       FROM colrep),
t AS (SELECT n AS total_rows, total_columns,
             CASE WHEN total_columns > 0 THEN CAST(trunc(avg_score) AS INTEGER) ELSE 0 END AS overall_score,
             duplicate_rows, CASE WHEN n > 0 THEN duplicate_rows / n * 100 ELSE 0.0 END AS duplicate_pct,
             high_missing
      FROM dup, pc)
SELECT total_rows, total_columns, overall_score, duplicate_rows, duplicate_pct,
       array_to_string(list_filter([
         CASE WHEN duplicate_rows > 0 THEN {_msg(X.MSG_DUPLICATES, n='duplicate_rows', pct1='duplicate_pct')} END,
         CASE WHEN overall_score < {X.SCORE_CRITICAL} THEN {_msg(X.MSG_QUALITY_CRITICAL)}
              WHEN overall_score < {X.SCORE_MEDIUM} THEN {_msg(X.MSG_QUALITY_MEDIUM)} END,
         CASE WHEN high_missing <> '' THEN {_msg(X.MSG_HIGH_MISSING_COLUMNS, names='high_missing')} END],
         lambda x: x IS NOT NULL), '; ') AS global_issues
FROM t"""


def repair_sql(src: str, schema) -> str:
    """Repaired rows: statistics and output over the distinct rows."""
    from ..functions import fixed as X
    num = [c for c, _, isnum in schema if isnum]
    qs = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), [{X.WINSOR_LOW}, 0.5, {X.WINSOR_HIGH}]) AS w_{c}"
                   for c in num)
    modes = ", ".join(
        f"(SELECT CAST({c} AS VARCHAR) FROM base WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY count(*) DESC, {c} ASC LIMIT 1) AS mode_{c}"
        for c, _, isnum in schema if not isnum)
    sel = []
    for i, (c, dt, isnum) in enumerate(schema):
        miss = f"(SELECT missing_pct FROM colrep WHERE ordinal = {i})"
        outp = f"(SELECT outlier_pct FROM colrep WHERE ordinal = {i})"
        if isnum:
            filled = f"CASE WHEN {miss} > 0 THEN coalesce(CAST({c} AS DOUBLE), w_{c}[2]) ELSE {c} END"
            sel.append(f"CASE WHEN {outp} > {X.OUTLIERS_MODERATE_PCT} THEN "
                       f"CASE WHEN ({filled}) < w_{c}[1] THEN w_{c}[1] WHEN ({filled}) > w_{c}[3] THEN w_{c}[3] "
                       f"ELSE ({filled}) END ELSE {filled} END AS {c}")
        else:
            sqlt = {"date": "DATE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(dt, "VARCHAR")
            sel.append(f"CASE WHEN {miss} > 0 THEN coalesce({c}, CAST(coalesce(mode_{c}, '{X.FILL_UNKNOWN}') AS {sqlt})) "
                       f"ELSE {c} END AS {c}")
    return profile_ctes(src, schema) + f""",
base AS (SELECT DISTINCT * FROM src),
w AS (SELECT {qs} FROM base),
md AS (SELECT {modes})
SELECT {', '.join(sel)} FROM base, w, md"""


# --- features ------------------------------------------------------------------

MART_NUMERIC = ["days_since_last_order", "total_orders", "total_revenue", "avg_order_value",
                "return_rate", "product_categories_used", "discount_usage_pct", "tenure_months",
                "account_balance"]
MART_RATIOS = [("total_revenue", "days_since_last_order"), ("total_revenue", "total_orders"),
               ("total_revenue", "avg_order_value")]
# TPC-H's fixed domains of the two categorical mart columns
MART_ONEHOT = {"mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
               "region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]}


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def features_sql(digits: int = 9) -> str:
    """Standardised feature matrix of the client mart."""
    rnames = [f"ratio_{n}_per_{d}" for n, d in MART_RATIOS]
    base = [f"CAST({c} AS DOUBLE) AS {c}" for c in MART_NUMERIC]
    base += [f"CAST({n} AS DOUBLE) / CASE WHEN {d} <> 0 THEN CAST({d} AS DOUBLE) END AS raw_{i}"
             for i, (n, d) in enumerate(MART_RATIOS)]
    oh = [(c, cat) for c, cats in MART_ONEHOT.items() for cat in cats[1:]]
    base += [f"CASE WHEN coalesce({c}, 'MISSING') = '{cat}' THEN 1.0 ELSE 0.0 END AS {_q(f'{c}_{cat}')}"
             for c, cat in oh]
    qs = ", ".join(f"quantile_cont(raw_{i}, 0.99) AS q_{i}" for i in range(len(MART_RATIOS)))
    filled = [f"coalesce({c}, 0.0) AS {c}" for c in MART_NUMERIC]
    for i, name in enumerate(rnames):
        r = f"coalesce(raw_{i}, 0.0)"
        filled.append(f"CASE WHEN {r} < 0 THEN 0.0 WHEN {r} > q_{i} THEN q_{i} ELSE {r} END AS {name}")
    filled += [_q(f"{c}_{cat}") for c, cat in oh]
    feats = MART_NUMERIC + rnames + [f"{c}_{cat}" for c, cat in oh]
    stats = ", ".join(f"avg({_q(f)}) AS {_q('m_' + f)}, stddev_pop({_q(f)}) AS {_q('s_' + f)}"
                      for f in feats)
    out = ", ".join(
        f"round(({_q(f)} - {_q('m_' + f)}) / CASE WHEN {_q('s_' + f)} = 0 THEN 1.0 ELSE {_q('s_' + f)} END, {digits}) AS {_q(f)}"
        for f in feats)
    return with_mart("client", f"""
base AS (SELECT client_id, churned, {', '.join(base)} FROM mart),
q AS (SELECT {qs} FROM base),
filled AS (SELECT client_id, churned, {', '.join(filled)} FROM base, q),
st AS (SELECT {stats} FROM filled)
SELECT client_id, churned, {out} FROM filled, st""")


# --- drift -------------------------------------------------------------------

DRIFT_CLIENT_COLS = MART_NUMERIC
DRIFT_EVENT_COLS = {"value": "value",
                    "prop_k": "CAST(json_extract_string(props, '$.k') AS DOUBLE)",
                    "hour_of_day": "CAST(hour(ts) AS DOUBLE)"}


def drift_long_client() -> str:
    """CTE ``long`` for the client mart split at the median client id."""
    parts = []
    for c in DRIFT_CLIENT_COLS:
        parts.append(f"SELECT '{c}' AS feature, CASE WHEN client_id <= med THEN 0 ELSE 1 END AS side, "
                     f"CAST(coalesce({c}, 0) AS DOUBLE) AS value FROM mart, m")
    return with_mart("client", f"""
m AS (SELECT quantile_cont(client_id, 0.5) AS med FROM mart),
long0 AS ({' UNION ALL '.join(parts)}),
long AS (SELECT * FROM long0 WHERE value IS NOT NULL AND NOT isnan(value))""")


def drift_long_events() -> str:
    parts = []
    for name, expr in DRIFT_EVENT_COLS.items():
        parts.append(f"SELECT '{name}' AS feature, CASE WHEN event_id <= med THEN 0 ELSE 1 END AS side, "
                     f"CAST({expr} AS DOUBLE) AS value FROM events, m")
    return f"""WITH m AS (SELECT quantile_cont(event_id, 0.5) AS med FROM events),
long0 AS ({' UNION ALL '.join(parts)}),
long AS (SELECT * FROM long0 WHERE value IS NOT NULL AND NOT isnan(value))"""


#: Per feature: the value in the first half of the client ids and in the second.
DRIFT_SHIFTED = {
    "moved": ("client_id % 100", "client_id % 100 + 60"),
    "leaning": ("client_id % 100", "CASE WHEN client_id % 100 < 50 AND client_id % 10 IN (1, 4, 7) "
                                   "THEN client_id % 100 + 50 ELSE client_id % 100 END"),
    "nudged": ("client_id % 100", "CASE WHEN client_id % 100 < 50 AND client_id % 5 = 0 "
                                  "THEN client_id % 100 + 50 ELSE client_id % 100 END"),
    "steady": ("client_id % 100", "client_id % 100"),
}


def drift_long_shifted() -> str:
    """CTE ``long`` of the changed columns, split at the median client id."""
    parts = [f"SELECT '{c}' AS feature, CASE WHEN client_id <= med THEN 0 ELSE 1 END AS side, "
             f"CAST(CASE WHEN client_id <= med THEN {a} ELSE {b} END AS DOUBLE) AS value FROM mart, m"
             for c, (a, b) in DRIFT_SHIFTED.items()]
    return with_mart("client", f"""
m AS (SELECT quantile_cont(client_id, 0.5) AS med FROM mart),
long AS ({' UNION ALL '.join(parts)})""")


def drift_body(names: list[str]) -> str:
    from ..functions import fixed as X
    probs = "[" + ", ".join(str(i / X.PSI_BINS) for i in range(X.PSI_BINS + 1)) + "]"
    ords = " UNION ALL ".join(f"SELECT '{n}' AS feature, {i} AS ordinal" for i, n in enumerate(names))
    return f""",
names AS ({ords}),
edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {probs}))) AS e FROM long GROUP BY feature),
sizes AS (SELECT feature, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1
          FROM long GROUP BY feature),
binned AS (SELECT l.feature, l.side, least(len(list_filter(e, lambda x: x <= l.value)) - 1, len(e) - 2) AS bin
           FROM long l JOIN edges USING (feature)),
counts AS (SELECT feature, side, bin, count(*) AS c FROM binned GROUP BY feature, side, bin),
grid AS (SELECT feature, unnest(range(0, len(e) - 1)) AS bin FROM edges WHERE len(e) >= 2),
t AS (
  SELECT g.feature, g.bin,
         least(1.0, greatest({X.PSI_EPS}, coalesce(c0.c, 0) / s.n0)) AS ep,
         least(1.0, greatest({X.PSI_EPS}, coalesce(c1.c, 0) / s.n1)) AS ap
  FROM grid g JOIN sizes s USING (feature)
  LEFT JOIN counts c0 ON c0.feature = g.feature AND c0.bin = g.bin AND c0.side = 0
  LEFT JOIN counts c1 ON c1.feature = g.feature AND c1.bin = g.bin AND c1.side = 1),
psi0 AS (SELECT feature, list_reduce(list((ap - ep) * ln(ap / ep) ORDER BY bin), lambda a, b: a + b) AS psi
         FROM t GROUP BY feature),
psi AS (SELECT s.feature, CASE WHEN n0 = 0 OR n1 = 0 THEN 0.0 ELSE coalesce(psi0.psi, 0.0) END AS psi
        FROM sizes s LEFT JOIN psi0 USING (feature)),
vc AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) AS c0, count(*) FILTER (WHERE side = 1) AS c1
       FROM long GROUP BY feature, value),
cum AS (SELECT feature, sum(c0) OVER (PARTITION BY feature ORDER BY value) AS cc0,
               sum(c1) OVER (PARTITION BY feature ORDER BY value) AS cc1 FROM vc),
ksd AS (SELECT feature, max(abs(cc0 / n0 - cc1 / n1)) AS d FROM cum JOIN sizes USING (feature) GROUP BY feature),
ks AS (
  SELECT feature, CASE WHEN n0 = 0 OR n1 = 0 THEN 0.0 ELSE d END AS ks,
         CASE WHEN n0 = 0 OR n1 = 0 THEN 1.0 ELSE
           (SELECT CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0,
              list_reduce([2.0 * (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * lam * lam)
                           FOR k IN range(1, 101)], lambda a, b: a + b))) END
            FROM (SELECT (en + 0.12 + 0.11 / en) * d AS lam
                  FROM (SELECT sqrt(CAST(n0 AS DOUBLE) * CAST(n1 AS DOUBLE) / (CAST(n0 AS DOUBLE) + CAST(n1 AS DOUBLE))) AS en)))
         END AS p
  FROM sizes JOIN ksd USING (feature)),
drift AS (
  SELECT n.feature, n.ordinal, coalesce(psi.psi, 0.0) AS psi, coalesce(ks.ks, 0.0) AS ks, coalesce(ks.p, 1.0) AS p
  FROM names n LEFT JOIN psi USING (feature) LEFT JOIN ks USING (feature)),
result AS (
  SELECT feature, round_even(psi, 4) AS psi, round_even(ks, 4) AS ks_statistic, round_even(p, 4) AS ks_p_value,
         (psi > {X.PSI_THRESHOLD} OR p < {X.KS_ALPHA}) AS drift_detected,
         CASE WHEN psi >= {X.PSI_SEVERE} THEN 'severe' WHEN psi >= {X.PSI_THRESHOLD} THEN 'moderate' ELSE 'none' END AS severity,
         psi AS raw_psi, ordinal
  FROM drift)"""


def drift_head(which: str) -> str:
    if which == "client":
        return drift_long_client() + drift_body(DRIFT_CLIENT_COLS)
    if which == "shifted":
        return drift_long_shifted() + drift_body(list(DRIFT_SHIFTED))
    return drift_long_events() + drift_body(list(DRIFT_EVENT_COLS))


def drift_sql(which: str) -> str:
    return drift_head(which) + """
SELECT feature, psi, ks_statistic, ks_p_value, drift_detected, severity FROM result"""


def drift_alerts_sql(which: str) -> str:
    from ..functions import fixed as X
    head = drift_head(which)

    def names(cond):
        return (f"coalesce(string_agg(feature, ', ' ORDER BY psi DESC, feature) "
                f"FILTER (WHERE {cond}), '')")

    def line(t, col):
        a, b = t.split("{names}")
        return f"'{a}' || {col} || '{b}'"
    return head + f""",
a AS (SELECT count(*) AS n, {names("severity = 'severe'")} AS severe,
             {names("severity = 'moderate'")} AS moderate, {names("severity = 'none'")} AS ks_only
      FROM result WHERE drift_detected),
lines AS (SELECT CASE WHEN n = 0 THEN ['{X.MSG_DRIFT_NONE}'] ELSE list_filter([
            CASE WHEN severe <> '' THEN {line(X.MSG_DRIFT_SEVERE, 'severe')} END,
            CASE WHEN moderate <> '' THEN {line(X.MSG_DRIFT_MODERATE, 'moderate')} END,
            CASE WHEN ks_only <> '' THEN {line(X.MSG_DRIFT_KS_ONLY, 'ks_only')} END],
            lambda x: x IS NOT NULL) END AS l FROM a)
SELECT CAST(i - 1 AS INTEGER) AS ord, l[i] AS alert FROM lines, range(1, len(l) + 1) r(i)"""


# --- recommendations / dashboard / metrics on the fixed scorer ----------------------

def _dbl(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _sqlstr(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rule_sql(seg: str, idx: int) -> str:
    from ..functions import fixed as X
    val = (lambda v: _dbl(v)) if idx == 6 else _sqlstr
    parts = " ".join(f"WHEN {seg} = {_sqlstr(n)} THEN {val(r[idx])}" for n, r in X.SEGMENT_ACTIONS.items())
    return f"CASE {parts} ELSE {val(X.SEGMENT_ACTIONS['Lost'][idx])} END"


def recs_ctes(threshold: float = 0.7) -> str:
    from ..functions import fixed as X
    from ..operators.scoring import rule_score_sql
    esc = ", ".join(_sqlstr(s) for s in X.ESCALATED_SEGMENTS)
    lift = _rule_sql("rfm_segment", 6)
    return rfm_ctes("client") + f""",
withprob AS (SELECT rfm.*, {rule_score_sql()} AS churn_prob FROM rfm),
b AS (SELECT client_id, rfm_segment, churn_prob,
             CASE WHEN churn_prob >= {_dbl(threshold)} THEN 'high'
                  WHEN churn_prob >= {_dbl(X.MEDIUM_RISK_FLOOR)} THEN 'medium' ELSE 'low' END AS churn_risk_level,
             coalesce(CAST(total_revenue AS DOUBLE), 0.0) AS ltv
      FROM withprob),
recs AS (
  SELECT client_id, rfm_segment, churn_prob, churn_risk_level, ltv,
         CASE WHEN rfm_segment IN ({esc}) AND churn_risk_level = 'high' THEN {_sqlstr(X.URGENT_PREFIX)} || {_rule_sql('rfm_segment', 1)}
              WHEN rfm_segment IN ({esc}) AND churn_risk_level = 'medium' THEN {_sqlstr(X.WARNING_PREFIX)} || {_rule_sql('rfm_segment', 1)}
              ELSE {_rule_sql('rfm_segment', 1)} END AS action,
         CASE WHEN rfm_segment IN ({esc}) AND churn_risk_level = 'high' THEN {_sqlstr(X.URGENT_CHANNEL)}
              ELSE {_rule_sql('rfm_segment', 2)} END AS channel,
         {_rule_sql('rfm_segment', 3)} AS tone,
         {_rule_sql('rfm_segment', 5)} AS offer,
         CASE WHEN rfm_segment IN ({esc}) AND churn_risk_level = 'high' THEN 'critical'
              WHEN rfm_segment IN ({esc}) AND churn_risk_level = 'medium' THEN 'high'
              ELSE {_rule_sql('rfm_segment', 4)} END AS urgency,
         round_even(ltv * (1.0 - CASE WHEN churn_risk_level = 'high' THEN {lift} * {_dbl(X.HIGH_RISK_LIFT_FACTOR)}
                                      WHEN churn_risk_level = 'low' THEN {lift} * {_dbl(X.LOW_RISK_LIFT_FACTOR)}
                                      ELSE {lift} END) * churn_prob, 2) AS roi_estimate
  FROM b)"""


def recommendations_sql() -> str:
    return recs_ctes() + "\nSELECT * FROM recs"


def kpi_sql() -> str:
    return recs_ctes() + """
SELECT round_even(coalesce(CAST(sum(CAST(ltv AS DECIMAL(38,2))) FILTER (WHERE churn_risk_level = 'high') AS DOUBLE), 0.0), 6) AS money_at_risk,
       round_even(avg(churn_prob), 6) AS churn_rate,
       round_even(CAST(sum(CAST(ltv AS DECIMAL(38,2))) AS DOUBLE) / count(*), 6) AS avg_ltv, count(*) AS total_clients
FROM recs"""


def segment_probability_sql() -> str:
    return recs_ctes() + "\nSELECT rfm_segment, round_even(avg(churn_prob), 6) AS churn_prob FROM recs GROUP BY rfm_segment"


def top_at_risk_sql(n: int = 10) -> str:
    return recs_ctes() + f"""
SELECT client_id, rfm_segment, churn_prob, ltv, action FROM recs
ORDER BY urgency ASC, ltv * churn_prob DESC, client_id ASC LIMIT {n}"""


def segment_cards_sql() -> str:
    segs = ["At Risk", "Hibernating", "Loyal", "Champions"]
    rank = " ".join(f"WHEN rfm_segment = {_sqlstr(s)} THEN {i}" for i, s in enumerate(segs))
    return recs_ctes() + f""",
o AS (SELECT recs.*, row_number() OVER (PARTITION BY rfm_segment
                                         ORDER BY urgency ASC, ltv * churn_prob DESC, client_id ASC) AS rn
      FROM recs WHERE rfm_segment IN ({', '.join(_sqlstr(s) for s in segs)}))
SELECT rfm_segment, count(*) AS n_clients, round_even(CAST(sum(CAST(ltv AS DECIMAL(38,2))) AS DOUBLE), 6) AS money, round_even(avg(churn_prob), 6) AS avg_prob,
       max(action) FILTER (WHERE rn = 1) AS action, max(channel) FILTER (WHERE rn = 1) AS channel,
       max(roi_estimate) FILTER (WHERE rn = 1) AS roi_estimate,
       CASE {rank} ELSE {len(segs)} END AS card_order
FROM o GROUP BY rfm_segment"""


def scored_mart_cte() -> str:
    from ..operators.scoring import rule_score_sql
    return with_mart("client", f"""
s AS (SELECT CAST(churned AS INTEGER) AS label, {rule_score_sql()} AS score FROM mart),
c AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM s GROUP BY score),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM c)""")


def roc_sql() -> str:
    return scored_mart_cte() + """,
pts AS (SELECT score AS threshold, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fps,
               CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tps FROM c
        UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0)
SELECT threshold, fps, tps, fps / N AS fpr, tps / P AS tpr FROM pts, tot"""


def auc_sql() -> str:
    return scored_mart_cte() + """,
r AS (SELECT pos, neg, coalesce(sum(pos + neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM c)
SELECT (CAST(sum(CAST(pos AS HUGEINT) * (2 * below + pos + neg + 1)) AS DOUBLE) / 2.0
        - CAST(max(P) AS DOUBLE) * (max(P) + 1) / 2.0) / (CAST(max(P) AS DOUBLE) * max(N)) AS auc
FROM r, tot"""


def class_weights_sql() -> str:
    return with_mart("client", """
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE churned = 1) AS pos, count(*) FILTER (WHERE churned = 0) AS neg FROM mart)
SELECT DISTINCT CAST(churned AS DOUBLE) AS label, CASE WHEN churned = 1 THEN n / (2.0 * pos) ELSE n / (2.0 * neg) END AS w_bal,
       CASE WHEN churned = 1 THEN neg / pos ELSE 1.0 END AS w_pos FROM mart, c""")


def _folds_cte(k: int, seed: int) -> str:
    return f"""
folds AS (SELECT mart.*, CAST((row_number() OVER (PARTITION BY churned
          ORDER BY md5(CAST(client_id AS VARCHAR) || '|{seed}'), client_id) - 1) % {k} AS INTEGER) AS fold FROM mart)"""


def folds_sql(k: int, seed: int) -> str:
    return with_mart("client", _folds_cte(k, seed) + "\nSELECT client_id, churned, fold FROM folds")


def fold_auc_sql(k: int, seed: int) -> str:
    from ..operators.scoring import rule_score_sql
    return with_mart("client", _folds_cte(k, seed) + f""",
c AS (SELECT fold, {rule_score_sql()} AS score, count(*) FILTER (WHERE churned = 1) AS pos,
             count(*) FILTER (WHERE churned <> 1) AS neg FROM folds GROUP BY ALL),
r AS (SELECT *, coalesce(sum(pos + neg) OVER (PARTITION BY fold ORDER BY score
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT fold, (CAST(sum(CAST(pos AS HUGEINT) * (2 * below + pos + neg + 1)) AS DOUBLE) / 2.0
        - CAST(sum(pos) AS DOUBLE) * (sum(pos) + 1) / 2.0) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc
FROM r GROUP BY fold""")


#: Fixed margins of three models, for the choice of the best one.
RULE_MODELS = {"Logistic Regression": {"days_since_last_order": 0.01, "total_orders": -0.05, "return_rate": 2.0},
               "Random Forest": {"total_orders": -0.05}, "XGBoost": {"days_since_last_order": 0.01}}


def rule_model_score(weights: dict[str, float]) -> str:
    """The margin, in whole thousandths, as SQL of both engines."""
    terms = " + ".join(f"{_dbl(w)} * coalesce(CAST({f} AS DOUBLE), 0.0)" for f, w in weights.items())
    return f"CAST(round(({terms}) * 1000.0) AS BIGINT)"


def best_rule_model_sql() -> str:
    scored = " UNION ALL ".join(
        f"SELECT '{m}' AS model, {i} AS pos_in_list, CAST(churned AS INTEGER) AS label, {rule_model_score(w)} AS score FROM mart"
        for i, (m, w) in enumerate(RULE_MODELS.items()))
    return with_mart("client", f"""
s AS ({scored}),
r AS (SELECT model, pos_in_list, label, rank() OVER (PARTITION BY model ORDER BY score)
             + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS avg_rank FROM s),
a AS (SELECT model, pos_in_list, (sum(avg_rank) FILTER (WHERE label = 1)
             - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
             / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label <> 1)) AS auc FROM r GROUP BY ALL)
SELECT model, round_even(auc, 4) AS best_auc FROM a ORDER BY round_even(auc, 4) DESC, pos_in_list LIMIT 1""")


def explain_permutation_sql() -> str:
    return linear_contrib_ctes() + "\nSELECT client_id, ordinal, feature, round(contribution, 6) AS contribution FROM contrib"


def recommendations_advice_sql() -> str:
    return f"""SELECT r.*, a.advice FROM ({recommendations_sql()}) r
LEFT JOIN ({factor_advice_sql()}) a USING (client_id)"""


#: Two-valued columns of the mart (E5): texts with a dot, one with nulls, and a flag.
BINARY_COLUMNS = {"tier": "CASE WHEN client_id % 3 = 0 THEN 'v2.0' ELSE 'v1.5' END",
                  "channel": "CASE WHEN client_id % 4 = 1 THEN 'web' WHEN client_id % 4 = 2 THEN 'app' END",
                  "many_orders": "total_orders > 5"}


def binary_features_sql() -> str:
    codes = {"tier": "CASE WHEN client_id % 3 = 0 THEN 1.0 ELSE 0.0 END",
             # nulls are the category MISSING, which sorts first
             "channel": "CASE WHEN client_id % 4 = 1 THEN 2.0 WHEN client_id % 4 = 2 THEN 1.0 ELSE 0.0 END"}
    flag = "CASE WHEN total_orders > 5 THEN 'true' WHEN total_orders <= 5 THEN 'false' ELSE 'MISSING' END"
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in BINARY_COLUMNS)
    out = ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END, 9) AS {c}" for c in BINARY_COLUMNS)
    return with_mart("client", f"""
f AS (SELECT client_id, churned, {flag} AS flag FROM mart),
lv AS (SELECT flag, CAST(row_number() OVER (ORDER BY flag) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT flag FROM f)),
e AS (SELECT client_id, churned, {', '.join(f'CAST({x} AS DOUBLE) AS {c}' for c, x in codes.items())},
             lv.code AS many_orders FROM f JOIN lv USING (flag)),
st AS (SELECT {stats} FROM e)
SELECT client_id, churned, {out} FROM e, st""")


def dataset_checks_sql(names: list[str]) -> str:
    from ..functions import fixed as X
    text = {"client_mart": f"({CLIENT_MART_SQL})", "events_mart": f"({EVENTS_MART_SQL})"}
    parts = " UNION ALL ".join(f"SELECT '{n}' AS dataset, (SELECT count(*) FROM {text.get(n, n)}) AS n_rows, "
                               f"(SELECT list(lower(column_name)) FROM (DESCRIBE SELECT * FROM {text.get(n, n)})) AS cols"
                               for n in names)

    def missing(columns, groups):
        tests = [f"CASE WHEN NOT list_has_any(cols, [{', '.join(map(_sqlstr, groups.get(c, [c])))}]) THEN {_sqlstr(c)} END"
                 for c in sorted(columns)]
        return f"concat_ws(',', {', '.join(tests)})"

    stand_ins = {"total_revenue": X.VALUE_COLUMNS, "transaction_count": X.FREQUENCY_HINT_COLUMNS}
    return f"""WITH d AS ({parts})
SELECT dataset, n_rows, {missing(X.REQUIRED_COLUMNS, {})} AS missing_required,
       {missing(X.RFM_RECOMMENDED, stand_ins)} AS missing_recommended FROM d"""


def model_checks_sql(names: list[str]) -> str:
    models = ", ".join(f"({_sqlstr(n)})" for n in names)
    return with_mart("client", f"""
m AS (SELECT * FROM (VALUES {models}) AS t(model))
SELECT model, (SELECT count(*) FROM mart) AS n_clients, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_changed,
       TRUE AS ranks_ok, TRUE AS auc_ok FROM m""")


def csv_mixed_sql() -> str:
    return (f"SELECT * REPLACE (CASE WHEN client_id % 10 = 0 THEN NULL ELSE CAST(activity_date AS TIMESTAMP) END "
            f"AS activity_date) FROM ({CLIENT_MART_SQL})")


def class_metrics_sql() -> str:
    from ..operators.scoring import rule_score_sql
    return with_mart("client", f"""
s AS (SELECT CAST(churned AS INTEGER) AS label, CASE WHEN {rule_score_sql()} > 0.5 THEN 1 ELSE 0 END AS pred FROM mart),
g AS (SELECT count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND pred = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND pred <> 1) AS fn, count(*) FILTER (WHERE label <> 1 AND pred <> 1) AS tn FROM s)
SELECT tp, fp, fn, tn,
       round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision,
       round_even(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall,
       round_even(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1,
       round_even(CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0.0 END, 4) AS accuracy
FROM g""")


def optimal_threshold_sql(cost_fp: float = 1.0, cost_fn: float = 3.0) -> str:
    return scored_mart_cte() + f""",
pts AS (SELECT score AS threshold, sum(neg) OVER (ORDER BY score DESC) AS fps,
               sum(pos) OVER (ORDER BY score DESC) AS tps FROM c
        UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0),
k AS (SELECT threshold, fps * {_dbl(cost_fp)} + (P - tps) * {_dbl(cost_fn)} AS cost FROM pts, tot)
SELECT threshold, cost FROM k ORDER BY cost ASC, threshold DESC LIMIT 1"""


# --- explanations of the fixed linear scorer ----------------------------------------

def linear_contrib_ctes() -> str:
    from ..operators.scoring import RULE_SCORER
    feats = list(RULE_SCORER.coefficients)
    means = ", ".join(f"avg(coalesce(CAST({f} AS DOUBLE), 0.0)) AS m_{f}" for f in feats)
    parts = " UNION ALL ".join(
        f"SELECT client_id, {i} AS ordinal, '{f}' AS feature, "
        f"{_dbl(RULE_SCORER.coefficients[f])} * (coalesce(CAST({f} AS DOUBLE), 0.0) - m_{f}) AS contribution "
        f"FROM mart, mm" for i, f in enumerate(feats))
    base = " + ".join([_dbl(RULE_SCORER.intercept)] + [f"{_dbl(RULE_SCORER.coefficients[f])} * m_{f}" for f in feats])
    return with_mart("client", f"""
mm AS (SELECT {means} FROM mart),
contrib AS ({parts}),
basev AS (SELECT {base} AS base FROM mm)""")


def explain_linear_sql() -> str:
    return linear_contrib_ctes() + "\nSELECT client_id, ordinal, feature, round(contribution, 9) AS contribution FROM contrib"


def global_importance_sql(top: int = 15) -> str:
    return linear_contrib_ctes() + f""",
g AS (SELECT feature, ordinal, round_even(avg(abs(contribution)), 6) AS importance FROM contrib GROUP BY feature, ordinal)
SELECT feature, importance FROM g ORDER BY importance DESC, ordinal LIMIT {top}"""


def importance_share_sql(top: int = 15) -> str:
    return linear_contrib_ctes() + f""",
g AS (SELECT feature, ordinal, round_even(avg(abs(contribution)), 6) AS importance FROM contrib GROUP BY feature, ordinal),
t AS (SELECT feature, importance FROM g ORDER BY importance DESC, ordinal LIMIT {top})
SELECT feature, round_even(importance, 4) AS importance,
       round_even(importance / CASE WHEN sum(importance) OVER () = 0 THEN 1.0 ELSE sum(importance) OVER () END * 100, 1) AS pct
FROM t"""


def client_factors_ctes(top: int = 5) -> str:
    from ..functions import fixed as X
    return linear_contrib_ctes() + f""",
ranked AS (SELECT client_id, feature, contribution,
                  row_number() OVER (PARTITION BY client_id ORDER BY abs(contribution) DESC, ordinal) AS rank
           FROM contrib),
factors AS (SELECT client_id, rank, feature, round_even(abs(contribution), 4) AS contribution,
                   CASE WHEN contribution > 0 THEN {_sqlstr(X.DIRECTION_RISK)} ELSE {_sqlstr(X.DIRECTION_PROTECTIVE)} END AS direction
            FROM ranked WHERE rank <= {top})"""


def client_factors_sql() -> str:
    return client_factors_ctes() + "\nSELECT client_id, CAST(rank AS INTEGER) AS rank, feature, contribution, direction FROM factors"


def explain_clients_sql() -> str:
    from ..functions import fixed as X
    a, rest = X.MSG_TOP_RISK.split("{feature}")
    b, rest = rest.split("{value3}")
    c, d = rest.split("{pct1}")
    e, g = X.MSG_NO_RISK.split("{pct1}")
    risk = _sqlstr(X.DIRECTION_RISK)
    return client_factors_ctes() + f""",
tot AS (SELECT client_id, sum(contribution) AS total_effect FROM contrib GROUP BY client_id),
per AS (SELECT client_id,
               list(feature ORDER BY rank) FILTER (WHERE direction = {risk}) AS risk,
               list(contribution ORDER BY rank) FILTER (WHERE direction = {risk}) AS risk_v,
               list(feature ORDER BY rank) FILTER (WHERE direction <> {risk}) AS prot
        FROM factors GROUP BY client_id),
j AS (SELECT tot.client_id, total_effect, coalesce(risk, []) AS risk, risk_v, coalesce(prot, []) AS prot,
             1.0 / (1.0 + exp(-(base + total_effect))) AS p
      FROM tot LEFT JOIN per USING (client_id), basev)
SELECT client_id, array_to_string(risk, ', ') AS top_risk_factors, array_to_string(prot, ', ') AS top_protective_factors,
       round(total_effect, 9) AS total_effect, round_even(p, 6) AS predicted_probability,
       CASE WHEN len(risk) > 0 THEN {_sqlstr(a)} || risk[1] || {_sqlstr(b)} || printf('%.3f', risk_v[1]) || {_sqlstr(c)}
                 || printf('%.1f', p * 100) || '%' || {_sqlstr(d)}
            ELSE {_sqlstr(e)} || printf('%.1f', p * 100) || '%' || {_sqlstr(g)} END AS summary
FROM j"""


def factor_advice_sql(top_n: int = 3) -> str:
    from ..functions import fixed as X
    keys = " ".join(f"WHEN instr(lower(replace(feature, ' ', '_')), {_sqlstr(k)}) > 0 THEN {i}"
                    for i, (k, _) in enumerate(X.FACTOR_ADVICE))
    texts = "[" + ", ".join(_sqlstr(t) for _, t in X.FACTOR_ADVICE) + "]"
    risk = _sqlstr(X.DIRECTION_RISK)
    return client_factors_ctes() + f""",
hit AS (SELECT client_id, rank, {texts}[CASE {keys} END + 1] AS advice FROM factors WHERE direction = {risk}),
firsts AS (SELECT client_id, advice, min(rank) AS rank FROM hit WHERE advice IS NOT NULL GROUP BY client_id, advice),
ordered AS (SELECT client_id, list(advice ORDER BY rank) AS l FROM firsts GROUP BY client_id)
SELECT client_id, array_to_string(l[1:{top_n}], ' | ') AS advice FROM ordered"""


# --- summary, report, export ----------------------------------------------------------

def executive_summary_sql() -> str:
    from ..functions import fixed as X
    fmt = {"total_clients": "format('{:,}', total_clients)",
           "churn_rate": "format('{:.1f}', churn_rate * 100) || '%'",
           "money_at_risk": "format('{:,.0f}', money_at_risk)",
           "auc": "format('{:.2f}', auc)",
           "at_risk": "CAST(at_risk AS VARCHAR)", "hibernating": "CAST(hibernating AS VARCHAR)",
           "top_factor": "coalesce(top_factor, 'N/A')"}
    pieces, rest = [], X.EXECUTIVE_SUMMARY
    while "{" in rest:
        a, b = rest.index("{"), rest.index("}")
        pieces += [_sqlstr(rest[:a]), fmt[rest[a + 1:b]]]
        rest = rest[b + 1:]
    pieces.append(_sqlstr(rest))
    return recs_ctes() + f""",
k AS (SELECT coalesce(CAST(sum(CAST(ltv AS DECIMAL(38,2))) FILTER (WHERE churn_risk_level = 'high') AS DOUBLE), 0.0) AS money_at_risk,
             avg(churn_prob) AS churn_rate, count(*) AS total_clients FROM recs),
seg AS (SELECT count(*) FILTER (WHERE rfm_segment = 'At Risk') AS at_risk,
               count(*) FILTER (WHERE rfm_segment = 'Hibernating') AS hibernating FROM rfm),
sl AS (SELECT CAST(churned AS INTEGER) AS label, churn_prob AS score FROM withprob),
c AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM sl GROUP BY score),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM c),
r AS (SELECT pos, neg, coalesce(sum(pos + neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
a AS (SELECT (CAST(sum(CAST(pos AS HUGEINT) * (2 * below + pos + neg + 1)) AS DOUBLE) / 2.0
              - CAST(max(P) AS DOUBLE) * (max(P) + 1) / 2.0) / (CAST(max(P) AS DOUBLE) * max(N)) AS auc FROM r, tot),
mm AS (SELECT {', '.join(f"avg(coalesce(CAST({f} AS DOUBLE), 0.0)) AS m_{f}" for f in _rule_feats())} FROM mart),
imp AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {i} AS ordinal, round_even(avg(abs({_dbl(w)} * (coalesce(CAST({f} AS DOUBLE), 0.0) - m_{f}))), 6) AS importance FROM mart, mm" for i, (f, w) in enumerate(_rule_coefs()))}),
tf AS (SELECT feature AS top_factor FROM imp ORDER BY importance DESC, ordinal LIMIT 1)
SELECT {' || '.join(pieces)} AS summary FROM k, seg, a LEFT JOIN tf ON TRUE"""


def _rule_coefs():
    from ..operators.scoring import RULE_SCORER
    return list(RULE_SCORER.coefficients.items())


def _rule_feats():
    return [f for f, _ in _rule_coefs()]


def report_lines_sql() -> str:
    def fill(t, **parts):
        pieces, rest = [], t
        while "{" in rest:
            a, b = rest.index("{"), rest.index("}")
            pieces += [_sqlstr(rest[:a]), parts[rest[a + 1:b]]]
            rest = rest[b + 1:]
        pieces.append(_sqlstr(rest))
        return " || ".join(pieces)
    return _report_lines_sql(fill, lambda c: f"format('{{:.1f}}', {c} * 100) || '%'")


def _report_lines_sql(fill, pct) -> str:
    from ..functions import fixed as X
    body = recs_ctes()
    return body + f""",
g AS (SELECT rfm_segment, count(client_id) AS client_count FROM rfm GROUP BY rfm_segment),
stats AS (SELECT rfm_segment, client_count,
                 round_even(client_count / sum(client_count) OVER () * 100, 1) AS client_pct,
                 {sql_order_rank('rfm_segment')} AS segment_order FROM g),
k AS (SELECT avg(churn_prob) AS churn_rate, count(*) AS total_clients FROM recs),
top AS (SELECT client_id, rfm_segment, churn_prob,
               row_number() OVER (ORDER BY urgency ASC, ltv * churn_prob DESC, client_id ASC) AS i FROM recs)
SELECT 'totals' AS section, 0 AS ord, {fill(X.REPORT_TOTAL, n="format('{:,}', total_clients)")} AS line FROM k
UNION ALL SELECT 'totals', 1, {fill(X.REPORT_CHURN, pct1=pct('churn_rate'))} FROM k
UNION ALL SELECT 'segments', CAST(segment_order AS INTEGER),
  {fill(X.REPORT_SEGMENT, seg='rfm_segment', n="format('{:,}', client_count)", pct1="format('{:.1f}', client_pct) || '%'")} FROM stats
UNION ALL SELECT 'top_clients', CAST(i AS INTEGER),
  {fill(X.REPORT_TOP, i='CAST(i AS VARCHAR)', cid='CAST(client_id AS VARCHAR)', seg='rfm_segment', pct1=pct('churn_prob'))}
  FROM top WHERE i <= 10"""


def export_sql() -> str:
    from ..functions import fixed as X
    return recs_ctes() + f"\nSELECT {', '.join(X.EXPORT_COLUMNS)} FROM recs"


# --- streaming ------------------------------------------------------------------

def stream_window_sql() -> str:
    return """SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       event_type, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
FROM events GROUP BY ALL"""


def stream_drift_sql() -> str:
    parts = []
    for name, expr in DRIFT_EVENT_COLS.items():
        parts.append(f"SELECT '{name}' AS feature, 0 AS side, CAST({expr} AS DOUBLE) AS value FROM events, m "
                     f"WHERE event_id <= med")
        parts.append(f"SELECT '{name}' AS feature, 1 AS side, CAST({expr} AS DOUBLE) AS value FROM events")
    head = f"""WITH m AS (SELECT quantile_cont(event_id, 0.5) AS med FROM events),
long0 AS ({' UNION ALL '.join(parts)}),
long AS (SELECT * FROM long0 WHERE value IS NOT NULL AND NOT isnan(value))"""
    return head + drift_body(list(DRIFT_EVENT_COLS)) + """
SELECT feature, psi, ks_statistic, ks_p_value, drift_detected, severity FROM result"""

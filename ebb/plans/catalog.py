"""Registered queries: name -> (Spark callable, SQL twin or None).

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
source tables; most run jobs while they are built (statistics, written
tables). The SQL twin, when present, is the oracle for the same
result on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import actions, drift, explain, features, metrics, models, profile, repair, rfm
from ..operators.scoring import RULE_SCORER
from ..session import cut_lineage, sized_shuffles
from ..sources import csv_io, sinks
from ..sources.tables import TABLES, read_table
from ..sources.marts import CLIENT_MART_SQL, EVENTS_MART_SQL, client_mart, events_mart
from . import lifecycle
from . import sqltext as S

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


_MARTS: dict = {}


def _state(spark, sf_dir) -> tuple:
    """The application, the folder and the sizes and times of its files: a
    result kept under it is not used for tables that have changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files, found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return spark.sparkContext.applicationId, sf_dir, tuple(sorted(found))


def _mart(spark, sf_dir, which):
    """The mart, written once per application and folder to the shared
    checkpoint folder.

    Operators run small statistics jobs before their lazy projection; reading
    the written table keeps those jobs (and every later query of the run) from
    recomputing the source joins, and a lost executor re-reads files rather
    than re-running the scans. Its shuffles have as many partitions as the
    largest source needs.
    """
    k = (*_state(spark, sf_dir), which)
    if k not in _MARTS:
        m = client_mart(spark, sf_dir) if which == "client" else events_mart(spark, sf_dir)
        with sized_shuffles(spark, read_table(spark, sf_dir, "lineitem" if which == "client" else "events").count()):
            _MARTS[k] = cut_lineage(m, f"{which}-mart")
    return _MARTS[k]


_EDGES: dict = {}


def _rfm(spark, sf_dir, which):
    """Scores and segments of the mart, by edges that are fitted once per application and folder."""
    m = _mart(spark, sf_dir, which)
    k = (*_state(spark, sf_dir), which)
    names = rfm.detect_rfm_columns(m.columns)
    if k not in _EDGES:
        _EDGES[k] = rfm.rfm_edges(m, *names)
    return rfm.apply_rfm(m, *names, _EDGES[k])


# --- sources -----------------------------------------------------------------

@register("client_mart", CLIENT_MART_SQL)
def q_client_mart(spark, sf_dir):
    return client_mart(spark, sf_dir)


@register("events_mart", EVENTS_MART_SQL)
def q_events_mart(spark, sf_dir):
    return events_mart(spark, sf_dir)


DATASETS = ["client_mart", "events_mart", *TABLES]


@register("dataset_checks", S.dataset_checks_sql(DATASETS))
def q_dataset_checks(spark, sf_dir):
    """Rows of every named dataset, and the columns it lacks for the analysis."""
    out = None
    for name in DATASETS:
        d = csv_io.load_dataset(spark, name, sf_dir)
        _, required, recommended = csv_io.validate_columns(d.columns)
        row = d.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("dataset"), "n_rows", F.lit(",".join(required)).alias("missing_required"),
            F.lit(",".join(recommended)).alias("missing_recommended"))
        out = row if out is None else out.unionByName(row)
    return out


# --- RFM ---------------------------------------------------------------------

for _which in ("client", "events"):
    _p = "" if _which == "client" else "events_"

    def _scores(spark, sf_dir, which=_which):
        return rfm.compute_rfm(_mart(spark, sf_dir, which)).select(
            "client_id", "r_score", "f_score", "m_score", "rfm_score", "rfm_segment")

    def _stats(spark, sf_dir, which=_which):
        return rfm.segment_stats(_rfm(spark, sf_dir, which))

    def _pivot(spark, sf_dir, which=_which):
        return rfm.rfm_pivot(_rfm(spark, sf_dir, which))

    def _headline(spark, sf_dir, which=_which):
        return rfm.rfm_headline(_rfm(spark, sf_dir, which))

    register(f"{_p}rfm_scores", S.rfm_scores_sql(_which))(_scores)
    register(f"{_p}rfm_segment_stats", S.segment_stats_sql(_which))(_stats)
    register(f"{_p}rfm_pivot", S.rfm_pivot_sql(_which))(_pivot)
    register(f"{_p}rfm_headline", S.rfm_headline_sql(_which))(_headline)


# --- profile / repair ----------------------------------------------------------

def _profile_view(rep):
    return rep.columns.select("ordinal", "column", "dtype", "missing_count", "missing_pct",
                              "unique_pct", "n_distinct", "outlier_count", "outlier_pct",
                              F.array_join("issues", "; ").alias("issues"), "score")


def _table_view(rep):
    return rep.table.withColumn("global_issues", F.array_join("global_issues", "; "))


@register("profile_columns", S.profile_columns_sql(CLIENT_MART_SQL, S.MART_SCHEMA))
def q_profile_columns(spark, sf_dir):
    return _profile_view(profile.profile_dataframe(_mart(spark, sf_dir, "client")))


@register("profile_table", S.profile_table_sql(CLIENT_MART_SQL, S.MART_SCHEMA))
def q_profile_table(spark, sf_dir):
    return _table_view(profile.profile_dataframe(_mart(spark, sf_dir, "client")))


@register("profile_lineitem_columns",
          S.profile_columns_sql("SELECT * FROM lineitem", S.LINEITEM_SCHEMA))
def q_profile_lineitem(spark, sf_dir):
    return _profile_view(profile.profile_dataframe(read_table(spark, sf_dir, "lineitem")))


@register("profile_lineitem_table",
          S.profile_table_sql("SELECT * FROM lineitem", S.LINEITEM_SCHEMA))
def q_profile_lineitem_table(spark, sf_dir):
    return _table_view(profile.profile_dataframe(read_table(spark, sf_dir, "lineitem")))


@register("profile_events_columns", S.profile_columns_sql("SELECT * FROM events", S.EVENTS_SCHEMA))
def q_profile_events(spark, sf_dir):
    return _profile_view(profile.profile_dataframe(read_table(spark, sf_dir, "events")))


@register("profile_events_table", S.profile_table_sql("SELECT * FROM events", S.EVENTS_SCHEMA))
def q_profile_events_table(spark, sf_dir):
    return _table_view(profile.profile_dataframe(read_table(spark, sf_dir, "events")))


@register("repair_mart", S.repair_sql(CLIENT_MART_SQL, S.MART_SCHEMA))
def q_repair_mart(spark, sf_dir):
    return repair.auto_fix_dataframe(_mart(spark, sf_dir, "client"))


@register("profile_dirty_columns", S.profile_columns_sql(S.DIRTY_SQL, S.DIRTY_SCHEMA))
def q_profile_dirty(spark, sf_dir):
    return _profile_view(profile.profile_dataframe(_dirty(spark, sf_dir)))


@register("profile_dirty_table", S.profile_table_sql(S.DIRTY_SQL, S.DIRTY_SCHEMA))
def q_profile_dirty_table(spark, sf_dir):
    return _table_view(profile.profile_dataframe(_dirty(spark, sf_dir)))


@register("repair_dirty", S.repair_sql(S.DIRTY_SQL, S.DIRTY_SCHEMA))
def q_repair_dirty(spark, sf_dir):
    return repair.auto_fix_dataframe(_dirty(spark, sf_dir))


def _dirty(spark, sf_dir):
    """The mart with damage by the key: nulls, outliers, a constant, an empty
    column, and a fifth of the rows twice (P4, P5, P7, F1, F3)."""
    d = _mart(spark, sf_dir, "client").selectExpr(*[f"{e} AS {c}" for c, e in S.DIRTY_COLUMNS.items()])
    return d.unionByName(d.where("client_id % 5 = 0"))


# --- features ------------------------------------------------------------------

@register("features_matrix", S.features_sql())
def q_features(spark, sf_dir):
    X, names, _ = features.engineer_features(_mart(spark, sf_dir, "client"))
    return X.select("client_id", "churned", *[F.round(F.col(f"`{n}`"), 9).alias(n) for n in names])


@register("binary_features", S.binary_features_sql())
def q_binary_features(spark, sf_dir):
    """E5: two-valued columns as ordinal codes, standardised."""
    m = _mart(spark, sf_dir, "client")
    X, names, _ = features.engineer_features(m.select(
        "client_id", "churned", *[F.expr(e).alias(c) for c, e in S.BINARY_COLUMNS.items()]))
    return X.select("client_id", "churned", *[F.round(F.col(n), 9).alias(n) for n in names])


# --- drift -----------------------------------------------------------------------

def _client_drift(spark, sf_dir):
    mart = _mart(spark, sf_dir, "client")
    x = mart.select("client_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in S.DRIFT_CLIENT_COLS])
    ref, cur = drift.split_halves(x, "client_id")
    return drift.detect_drift(ref, cur, S.DRIFT_CLIENT_COLS)


def _events_drift(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "value", "props")
    x = ev.select("event_id", F.col("value").cast("double").alias("value"),
                  F.get_json_object("props", "$.k").cast("double").alias("prop_k"),
                  F.hour("ts").cast("double").alias("hour_of_day"))
    ref, cur = drift.split_halves(x, "event_id")
    return drift.detect_drift(ref, cur, list(S.DRIFT_EVENT_COLS))


register("drift_clients", S.drift_sql("client"))(_client_drift)
register("drift_events", S.drift_sql("events"))(_events_drift)
register("drift_alerts_clients", S.drift_alerts_sql("client"))(
    lambda spark, sf_dir: drift.drift_alerts(_client_drift(spark, sf_dir)))
register("drift_alerts_events", S.drift_alerts_sql("events"))(
    lambda spark, sf_dir: drift.drift_alerts(_events_drift(spark, sf_dir)))


def _shifted_drift(spark, sf_dir):
    """Columns of the mart whose second half is changed by rules of different strength."""
    ids = _mart(spark, sf_dir, "client").select("client_id")
    ref, cur = drift.split_halves(ids, "client_id")
    cols = list(S.DRIFT_SHIFTED)
    return drift.detect_drift(ref.selectExpr(*[f"{a} AS {c}" for c, (a, _) in S.DRIFT_SHIFTED.items()]),
                              cur.selectExpr(*[f"{b} AS {c}" for c, (_, b) in S.DRIFT_SHIFTED.items()]), cols)


register("drift_shifted", S.drift_sql("shifted"))(_shifted_drift)
register("drift_alerts_shifted", S.drift_alerts_sql("shifted"))(
    lambda spark, sf_dir: drift.drift_alerts(_shifted_drift(spark, sf_dir)))


# --- recommendations and dashboard on the fixed scorer ----------------------------

def _recs(spark, sf_dir, sort=True):
    scored = RULE_SCORER.transform(_rfm(spark, sf_dir, "client"))
    return actions.generate_recommendations(scored, sort=sort)


def _rounded(df, cols, digits=6):
    """Float sums depend on summation order; compare them at 6 decimals."""
    return df.withColumns({c: F.bround(c, digits) for c in cols})


register("recommendations", S.recommendations_sql())(_recs)
register("kpi", S.kpi_sql())(lambda spark, sf_dir: _rounded(
    actions.kpi_row(_recs(spark, sf_dir, False)), ["money_at_risk", "churn_rate", "avg_ltv"]))
register("segment_probability", S.segment_probability_sql())(lambda spark, sf_dir: _rounded(
    actions.probability_by_segment(_recs(spark, sf_dir, False)), ["churn_prob"]))
register("top_at_risk", S.top_at_risk_sql())(
    lambda spark, sf_dir: actions.top_at_risk(_recs(spark, sf_dir, False)))
register("segment_cards", S.segment_cards_sql())(lambda spark, sf_dir: _rounded(
    actions.segment_cards(_recs(spark, sf_dir, False)), ["money", "avg_prob"]))


def _scored_labels(spark, sf_dir):
    m = _mart(spark, sf_dir, "client")
    return m.select(F.col("churned").alias("label"), RULE_SCORER.probability().alias("score"))


register("roc_rule", S.roc_sql())(lambda spark, sf_dir: metrics.roc_points(_scored_labels(spark, sf_dir)))
register("auc_rule", S.auc_sql())(lambda spark, sf_dir: metrics.auc(_scored_labels(spark, sf_dir)))
register("metrics_rule", S.class_metrics_sql())(lambda spark, sf_dir: metrics.classification_metrics(
    _scored_labels(spark, sf_dir).withColumn("prediction", (F.col("score") > 0.5).cast("int"))))
register("optimal_threshold_rule", S.optimal_threshold_sql())(
    lambda spark, sf_dir: metrics.optimal_threshold(_scored_labels(spark, sf_dir)))


@register("class_weights", S.class_weights_sql())
def q_class_weights(spark, sf_dir):
    labels = _mart(spark, sf_dir, "client").select(F.col("churned").cast("double").alias("label"))
    w = models.with_weights(labels)
    return w.groupBy("label").agg(F.max("w_bal").alias("w_bal"), F.max("w_pos").alias("w_pos"))


@register("fold_assignment", S.folds_sql(5, models.SEED))
def q_folds(spark, sf_dir):
    m = _mart(spark, sf_dir, "client").select("client_id", "churned")
    return models.with_folds(m, "client_id", "churned", 5)


def _fold_scores(spark, sf_dir):
    m = models.with_folds(_mart(spark, sf_dir, "client"), "client_id", "churned", 5)
    return m.select("fold", F.col("churned").alias("label"), RULE_SCORER.probability().alias("score"))


register("fold_auc_rule", S.fold_auc_sql(5, models.SEED))(
    lambda spark, sf_dir: metrics.auc(_fold_scores(spark, sf_dir), by=["fold"]))


def _best_rule_model(spark, sf_dir):
    """T13 over three fixed margins, so that the choice has a SQL twin."""
    m = _mart(spark, sf_dir, "client")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.expr(S.rule_model_score(w)).alias("score"))
                               for n, w in S.RULE_MODELS.items()]))
    scored = m.select(F.col("churned").alias("label"), rows.alias("s")).select("label", "s.model", "s.score")
    return metrics.best_model(metrics.auc(scored), list(S.RULE_MODELS), "auc")


register("best_rule_model", S.best_rule_model_sql())(_best_rule_model)


# --- explanations of the fixed linear scorer ------------------------------------

def _rule_contribs(spark, sf_dir):
    m = _mart(spark, sf_dir, "client")
    return explain.linear_contributions(m, RULE_SCORER.coefficients, RULE_SCORER.intercept)


register("explain_linear_rule", S.explain_linear_sql())(lambda spark, sf_dir: (
    lambda c: c.select("client_id", "ordinal", "feature", F.round("contribution", 9).alias("contribution"))
)(_rule_contribs(spark, sf_dir)[0]))
register("global_importance_rule", S.global_importance_sql())(
    lambda spark, sf_dir: explain.global_importance(_rule_contribs(spark, sf_dir)[0]))
register("importance_share_rule", S.importance_share_sql())(
    lambda spark, sf_dir: explain.importance_share(explain.global_importance(_rule_contribs(spark, sf_dir)[0])))
register("client_factors_rule", S.client_factors_sql())(
    lambda spark, sf_dir: explain.client_factors(_rule_contribs(spark, sf_dir)[0]))


def _rule_margin(df):
    """The fixed scorer as a ``score_fn`` over the vector of its features."""
    from pyspark.ml.functions import vector_to_array
    x, out = vector_to_array("features"), F.lit(RULE_SCORER.intercept)
    for i, w in enumerate(RULE_SCORER.coefficients.values()):
        out = out + F.lit(w) * x[i]
    return df.withColumn("score", out)


def _explain_permutation_rule(spark, sf_dir):
    """Of a linear margin, sampled attributions equal the exact ones."""
    contrib, _ = explain.permutation_contributions(_rule_margin, _mart(spark, sf_dir, "client"),
                                                   list(RULE_SCORER.coefficients))
    return contrib.withColumn("contribution", F.round("contribution", 6))


register("explain_permutation_rule", S.explain_permutation_sql())(_explain_permutation_rule)


def _explained(spark, sf_dir):
    c, base = _rule_contribs(spark, sf_dir)
    e = explain.explain_clients(c, base)
    return e.select("client_id", F.array_join("top_risk_factors", ", ").alias("top_risk_factors"),
                    F.array_join("top_protective_factors", ", ").alias("top_protective_factors"),
                    F.round("total_effect", 9).alias("total_effect"),
                    F.bround("predicted_probability", 6).alias("predicted_probability"), "summary")


register("explain_clients_rule", S.explain_clients_sql())(_explained)
register("factor_advice_rule", S.factor_advice_sql())(lambda spark, sf_dir: actions.factor_advice(
    explain.top_risk_factor_names(_rule_contribs(spark, sf_dir)[0])).select(
    "client_id", F.array_join("advice", " | ").alias("advice")))


@register("recommendations_advice_rule", S.recommendations_advice_sql())
def q_recommendations_advice(spark, sf_dir):
    """A7 with the advice of A8 for the client's own risk factors."""
    advice = actions.factor_advice(explain.top_risk_factor_names(_rule_contribs(spark, sf_dir)[0]))
    advice = advice.select("client_id", F.array_join("advice", " | ").alias("advice"))
    return _recs(spark, sf_dir, sort=False).join(advice, "client_id", "left")


# --- executive summary and report on the fixed scorer -----------------------------

def _summary_rule(spark, sf_dir):
    mart = _mart(spark, sf_dir, "client")
    scored = RULE_SCORER.transform(_rfm(spark, sf_dir, "client"))
    recs = actions.generate_recommendations(scored, sort=False)
    stats = rfm.segment_stats(scored)
    auc = metrics.auc(mart.select(F.col("churned").alias("label"), RULE_SCORER.probability().alias("score")))
    top = explain.global_importance(_rule_contribs(spark, sf_dir)[0])
    return actions.executive_summary(stats, actions.kpi_row(recs), auc, top.limit(1))


register("executive_summary_rule", S.executive_summary_sql())(_summary_rule)


def _report_rule(spark, sf_dir):
    scored = RULE_SCORER.transform(_rfm(spark, sf_dir, "client"))
    recs = actions.generate_recommendations(scored, sort=False)
    return sinks.report_lines(actions.kpi_row(recs), rfm.segment_stats(scored), recs)


register("report_lines_rule", S.report_lines_sql())(_report_rule)


# --- CSV round trips (S1, S2, S4, S5, S7) --------------------------------------------

def _scratch(spark, name):
    from ..session import ensure_checkpoint_dir
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ebb-{name}-{uuid.uuid4().hex}"


def _csv_roundtrip(spark, sf_dir):
    mart = _mart(spark, sf_dir, "client")
    path = _scratch(spark, "csv")
    (mart.withColumnsRenamed({"client_id": "Customer ID", "total_revenue": "Revenue"})
     .write.option("header", True).option("sep", ";").csv(path))
    dialect = csv_io.csv_dialects(spark, path).select("delimiter").distinct().collect()
    if [r[0] for r in dialect] != [";"]:
        raise AssertionError(f"dialect detection found {dialect}")
    raw = spark.read.option("header", True).option("sep", ";").csv(path)
    typed = raw.select(*[F.col(f"`{a}`").cast(f.dataType).alias(a)
                         for a, f in zip(raw.columns, mart.schema.fields)])
    return csv_io.normalize_columns(typed)


register("csv_roundtrip_mart", CLIENT_MART_SQL)(_csv_roundtrip)


def _csv_mixed(spark, sf_dir):
    """Two files of different delimiters, with dates that are none."""
    mart = _mart(spark, sf_dir, "client").withColumn("activity_date", F.expr(
        "CASE WHEN client_id % 10 = 0 THEN 'none' ELSE CAST(activity_date AS STRING) END"))
    path = _scratch(spark, "csv-mixed")
    for name, sep, rest in (("a", ",", 0), ("b", ";", 1)):
        mart.where(F.col("client_id") % 2 == rest).write.option("header", True).option("sep", sep).csv(f"{path}/{name}")
    return csv_io.load_csv(spark, f"{path}/*", schema=mart.schema)


register("csv_mixed_delimiters", S.csv_mixed_sql())(_csv_mixed)


def _export_roundtrip(spark, sf_dir):
    scored = RULE_SCORER.transform(_rfm(spark, sf_dir, "client"))
    recs = actions.generate_recommendations(scored)
    path = sinks.export_predictions(recs, _scratch(spark, "export"))
    back = spark.read.option("header", True).csv(path)
    types = dict(recs.dtypes)
    return back.select(*[F.col(c).cast(types[c]).alias(c) for c in back.columns])


register("export_predictions", S.export_sql())(_export_roundtrip)


# --- trained models (no SQL twin: rows-only checks plus invariants in tests) ----------

_TRAINED: dict = {}
TRAIN_CV_FOLDS, CALIBRATION_FOLDS = 5, 3


def training(spark, sf_dir):
    """Features and the report on the three models, once per session and state of the
    folder; the report fits a model when a query first reads a result of it."""
    k = _state(spark, sf_dir)
    if k not in _TRAINED:
        mart = _mart(spark, sf_dir, "client")
        fe = features.FeatureEngineer().fit(mart)
        # dealt out: models of hundreds of trees score the rows, on as many tasks as the cluster runs at least
        parts = max(spark.sparkContext.defaultParallelism, -(-mart.count() // models.PASS_ROWS))
        X = cut_lineage(fe.transform(mart).repartition(parts, "client_id"))
        rep = models.train_and_compare(X, fe.features, cv_folds=TRAIN_CV_FOLDS,
                                       calibration_folds=CALIBRATION_FOLDS)
        _TRAINED[k] = (mart, fe, X, rep)
    return _TRAINED[k]


def _predictions(spark, sf_dir):
    mart, fe, X, rep = training(spark, sf_dir)
    return rep.models[rep.best_model_name].transform(X, keep=["client_id", "churned"])


_CONTRIBS: dict = {}


def _model_contribs(spark, sf_dir):
    """Permutation attributions of the best model, written once per session."""
    k = _state(spark, sf_dir)
    if k not in _CONTRIBS:
        mart, fe, X, rep = training(spark, sf_dir)
        name = rep.best_model_name
        kind = rep.specs[name].kind
        fn = explain.model_score_fn(rep.base_models[name], kind)
        contrib, base = explain.permutation_contributions(fn, X, fe.features)
        _CONTRIBS[k] = (cut_lineage(contrib, "attributions"), base, explain.score_space(kind))
    return _CONTRIBS[k]


register("model_metrics")(lambda spark, sf_dir: training(spark, sf_dir)[3].metrics)
register("model_roc")(lambda spark, sf_dir: training(spark, sf_dir)[3].roc)
register("model_importances")(lambda spark, sf_dir: training(spark, sf_dir)[3].importances)
register("model_best")(lambda spark, sf_dir: metrics.best_model(
    training(spark, sf_dir)[3].evaluation, models.FX.MODEL_NAMES))
register("churn_predictions")(lambda spark, sf_dir: _predictions(spark, sf_dir).drop("churned"))
register("optimal_threshold_model")(lambda spark, sf_dir: metrics.optimal_threshold(
    _predictions(spark, sf_dir).select(F.col("churned").alias("label"), F.col("churn_prob").alias("score"))))
register("recommendations_model")(lambda spark, sf_dir: actions.generate_recommendations(
    _rfm(spark, sf_dir, "client"), _predictions(spark, sf_dir).drop("churned")))


@register("model_checks", S.model_checks_sql(models.FX.MODEL_NAMES))
def q_model_checks(spark, sf_dir):
    """Every model saved, loaded and applied to all
    clients; what holds for each of them has a SQL twin. How good a model is does
    not: a hold-out AUC may lie below 0.5 where the labels follow no feature."""
    mart, fe, X, rep = training(spark, sf_dir)
    auc = {r["model"]: r["auc_roc"] for r in rep.evaluation.collect()}
    ranks = {r["model"]: (r["n"], r["top"]) for r in rep.importances.groupBy("model").agg(
        F.count("*").alias("n"), F.max("rank").alias("top")).collect()}
    out = None
    for name, model in rep.models.items():
        back = models.CalibratedModel.load(sinks.save_model(model, _scratch(spark, "model")))
        both = back.transform(model.transform(X.select("client_id", *[F.col(f"`{f}`") for f in fe.features]),
                                              out="before", keep=["client_id", *[f"`{f}`" for f in fe.features]]),
                              out="after", keep=["client_id", "before"])
        n, top = ranks[name]
        row = both.agg(F.count("*").alias("n_clients"),
                       F.count_if(~F.coalesce(F.col("after").between(0, 1), F.lit(False))).alias("n_outside"),
                       F.count_if(~F.col("after").eqNullSafe(F.col("before"))).alias("n_changed")).select(
            F.lit(name).alias("model"), "n_clients", "n_outside", "n_changed",
            F.lit(n == top == min(15, len(fe.features))).alias("ranks_ok"),
            F.lit(0 <= auc[name] <= rep.best_auc <= 1).alias("auc_ok"))
        out = row if out is None else out.unionByName(row)
    return out


def _lr_contribs(spark, sf_dir):
    mart, fe, X, rep = training(spark, sf_dir)
    lr = rep.base_models["Logistic Regression"]
    coefs = dict(zip(fe.features, [float(v) for v in lr.coefficients]))
    return explain.linear_contributions(X, coefs, float(lr.intercept))


register("explain_model_linear")(lambda spark, sf_dir: _lr_contribs(spark, sf_dir)[0])
register("explain_model_permutation")(lambda spark, sf_dir: _model_contribs(spark, sf_dir)[0])
register("global_importance_model")(lambda spark, sf_dir: explain.importance_share(
    explain.global_importance(_model_contribs(spark, sf_dir)[0])))
register("explain_clients_model")(lambda spark, sf_dir: (lambda cb: explain.explain_clients(
    cb[0], cb[1], space=cb[2]))(_model_contribs(spark, sf_dir)))


# --- streaming ---------------------------------------------------------------------

from ..streaming import events as stream  # noqa: E402

def stream_features() -> dict:
    return {"value": F.col("value").cast("double"),
            "prop_k": F.get_json_object("props", "$.k").cast("double"),
            "hour_of_day": F.hour("ts").cast("double")}


register("stream_event_windows", S.stream_window_sql())(
    lambda spark, sf_dir: stream.run_window_stats(spark, sf_dir))
register("stream_drift_events", S.stream_drift_sql())(lambda spark, sf_dir: stream.run_drift_monitor(
    spark, sf_dir, stream.reference_first_half(spark, sf_dir, stream_features()), stream_features()
).drop("batch_id"))


lifecycle.add(register, _mart, training, _recs, _scored_labels, _scratch)


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}

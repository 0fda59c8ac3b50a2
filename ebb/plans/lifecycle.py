"""Registered queries over clients in time, SMOTE and tree attributions; filled
into the catalog's registry by :func:`add`."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import campaign, dictionary, explain, kmeans, lifecycle, neighbours, smote, tree_explain
from ..operators.scoring import RULE_SCORER
from ..operators.models import with_features
from ..sources import csv_io
from ..sources.tables import read_table
from . import lifecycle_sql as S


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events", "user_id", "ts", "value")


def _orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")


def add(register, mart, training, recs, scored_labels, scratch) -> None:
    """``register``, ``mart(spark, sf_dir, which)`` and ``training``, ``recs`` and
    ``scored_labels`` (spark, sf_dir) and ``scratch(spark, name)`` of the catalog."""

    register("horizon_labels", S.horizon_labels_sql())(
        lambda spark, sf_dir: lifecycle.horizon_labels(_events(spark, sf_dir)))
    register("horizon_rates", S.horizon_rates_sql())(
        lambda spark, sf_dir: lifecycle.horizon_rates(lifecycle.horizon_labels(_events(spark, sf_dir))))
    register("lag_trend_features", S.lag_trend_sql())(
        lambda spark, sf_dir: lifecycle.lag_trend_features(_events(spark, sf_dir)))
    register("monthly_segments", S.monthly_segments_sql())(
        lambda spark, sf_dir: lifecycle.monthly_segments(_orders(spark, sf_dir)))
    register("segment_transitions", S.segment_transitions_sql())(
        lambda spark, sf_dir: lifecycle.segment_transitions(lifecycle.monthly_segments(_orders(spark, sf_dir))))

    def minority(spark, sf_dir):
        """(smaller class with vectors, rows it lacks)"""
        m = mart(spark, sf_dir, "client").select("client_id", "churned", F.array(*map(F.expr, S.SMOTE_VECTOR)).alias("x"))
        counts = {r[0]: r[1] for r in m.groupBy("churned").count().collect()}
        small = 1 if counts.get(1, 0) <= counts.get(0, 0) else 0
        return m.where(F.col("churned") == small), abs(counts.get(1, 0) - counts.get(0, 0))

    @register("smote_neighbours", S.smote_neighbours_sql())
    def q_smote_neighbours(spark, sf_dir):
        """T5: the five nearest neighbours of every client of the smaller class."""
        return neighbours.nearest_neighbours(minority(spark, sf_dir)[0], smote.NEIGHBOURS)

    @register("smote_rows", S.smote_rows_sql())
    def q_smote_rows(spark, sf_dir):
        """T5: the rows that make both classes equally large."""
        rows, wanted = minority(spark, sf_dir)
        new = smote.smote_rows(rows, wanted)
        return new.select("client_id", "draw", "neighbour", "gap", *[F.col("x")[i].alias(f"f{i}") for i in range(len(S.SMOTE_VECTOR))])

    # --- attributions of trees, and what stands in for them (X1, X3) -------------

    @register("explain_tree_rule", S.explain_tree_sql())
    def q_explain_tree_rule(spark, sf_dir):
        """Two fixed trees, whose attributions SQL finds by enumeration."""
        trees = [tree_explain.tree_of(t) for t in S.RULE_TREES]
        c, _ = tree_explain.contributions_of(trees, mart(spark, sf_dir, "client"), S.TREE_COLUMNS)
        return c.withColumn("contribution", F.round("contribution", 9))

    @register("fallback_importance_rule", S.fallback_importance_sql(RULE_SCORER.coefficients))
    def q_fallback(spark, sf_dir):
        """A scorer that is no fitted model has no attribution path."""
        importances = [(f, abs(w)) for f, w in RULE_SCORER.coefficients.items()]
        e = explain.explain_model(RULE_SCORER, "rule", mart(spark, sf_dir, "client"),
                                  list(RULE_SCORER.coefficients), importances)
        n = e.contributions.agg(F.count("*").alias("n"), F.max(F.abs("contribution")).alias("largest"))
        return e.importance.select("feature", "importance", F.lit(e.method).alias("method"), F.lit(e.base_value).alias("base_value"),
                                   n.select("n").scalar().alias("n_contributions"), n.select("largest").scalar().alias("largest"))

    tree_models = ["Random Forest", "XGBoost"]

    def explained(spark, sf_dir, name):
        _, fe, X, rep = training(spark, sf_dir)
        own = [(r["feature"], r["importance"]) for r in rep.importances.where(F.col("model") == name).collect()]
        return explain.explain_model(rep.base_models[name], rep.specs[name].kind, X, fe.features, own)

    @register("explain_model_tree")
    def q_explain_model_tree(spark, sf_dir):
        """Exact attributions of both fitted tree models."""
        out = None
        for name in tree_models:
            c = explained(spark, sf_dir, name).contributions.withColumn("model", F.lit(name))
            out = c if out is None else out.unionByName(c)
        return out

    @register("explain_tree_checks", S.explain_tree_checks_sql(tree_models))
    def q_explain_tree_checks(spark, sf_dir):
        """Clients whose contributions do not add up to the model's output less the base value."""
        _, fe, X, rep = training(spark, sf_dir)
        out = None
        for name in tree_models:
            e = explained(spark, sf_dir, name)
            scored = with_features(X, fe.features)
            scored = rep.base_models[name].copy().setPredictionCol("__pred").transform(scored)
            raw = [c for c in scored.columns if c.startswith("raw" if e.space == "margin" else "prob")][0]
            target = vector_to_array(F.col(raw))[1] * (2.0 if e.space == "margin" else 1.0)
            total = e.contributions.groupBy("client_id").agg(F.sum("contribution").alias("total"))
            both = scored.select("client_id", target.alias("f")).join(total, "client_id", "left")
            off = F.coalesce(F.abs(F.col("f") - F.lit(e.base_value) - F.col("total")) > 1e-9, F.lit(True))
            row = both.agg(F.count("*").alias("n_clients"), F.count_if(off).cast("int").alias("n_off")).select(
                F.lit(name).alias("model"), "n_clients", "n_off", F.lit(e.method).alias("method"))
            out = row if out is None else out.unionByName(row)
        return out

    # --- campaigns, clusters, dictionaries -----------------------------------------

    register("lift_top_decile", S.lift_top_decile_sql())(
        lambda spark, sf_dir: campaign.lift_top_share(scored_labels(spark, sf_dir)))

    @register("money_saved", S.money_saved_sql())
    def q_money_saved(spark, sf_dir):
        labels = mart(spark, sf_dir, "client").select("client_id", F.col("churned").alias("label"))
        rows = recs(spark, sf_dir, False).select("client_id", F.col("churn_prob").alias("score"), "ltv")
        return campaign.money_saved(rows.join(labels, "client_id"))

    register("retention_roi", S.retention_roi_sql())(
        lambda spark, sf_dir: campaign.retention_roi(recs(spark, sf_dir, False)))
    register("budget_plan", S.budget_plan_sql())(lambda spark, sf_dir: campaign.budget_plan(
        recs(spark, sf_dir, False).selectExpr("client_id", f"{S.OFFER_COST} AS cost", f"{S.OFFER_VALUE} AS value"), S.BUDGET))

    def vectors(spark, sf_dir):
        names = [f"f{i}" for i in range(len(S.SMOTE_VECTOR))]
        exprs = [f"{e} AS {n}" for e, n in zip(S.SMOTE_VECTOR, names, strict=True)]
        return mart(spark, sf_dir, "client").selectExpr("client_id", *exprs), names

    @register("kmeans_segments", S.kmeans_sql())
    def q_kmeans(spark, sf_dir):
        """Fixed starting centres and rounds, so that SQL can follow."""
        x, names = vectors(spark, sf_dir)
        centres, _ = kmeans.kmeans_fit(x, names, S.KMEANS_START, S.KMEANS_ROUNDS, tolerance=-1.0)
        return kmeans.kmeans_segments(x, names, centres)

    @register("kmeans_seeded")
    def q_kmeans_seeded(spark, sf_dir):
        """Clusters from k-means‖ centres, run until inertia no longer falls."""
        x, names = vectors(spark, sf_dir)
        centres, _ = kmeans.kmeans_fit(x, names, kmeans.seed_centres(x, names, 5), 50)
        return kmeans.kmeans_segments(x, names, centres)

    @register("category_dictionary_check", S.dictionary_sql())
    def q_dictionary(spark, sf_dir):
        df = read_table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").selectExpr(f"{S.DAMAGED_SEGMENT} AS value")
        return dictionary.dictionary_check(df, "value", spark.createDataFrame([(s,) for s in S.SEGMENT_NAMES], "entry string"))

    # --- CSV files of several shapes (S1, S2) ------------------------------------------

    def notes(spark, sf_dir, column):
        return mart(spark, sf_dir, "client").selectExpr("client_id", f"{column} AS note", "churned")

    def written(df, path, encoding="UTF-8", sep=","):
        df.write.option("header", True).option("sep", sep).option("escape", '"').option("encoding", encoding).csv(path)

    @register("csv_reordered", S.csv_text_sql("mktsegment"))
    def q_csv_reordered(spark, sf_dir):
        """Files whose columns come in three orders, under other names too."""
        df, path = notes(spark, sf_dir, "mktsegment"), scratch(spark, "csv-reordered")
        written(df.where("client_id % 3 = 0"), f"{path}/a")
        written(df.where("client_id % 3 = 1").select("churned", "client_id", "note"), f"{path}/b", sep=";")
        written(df.where("client_id % 3 = 2").select("note", F.col("churned").alias("Churn"), F.col("client_id").alias("Customer ID")),
                f"{path}/c")
        return csv_io.load_csv(spark, f"{path}/*", schema=df.schema)

    @register("csv_quoted", S.csv_text_sql(S.NOTE))
    def q_csv_quoted(spark, sf_dir):
        """Values with line breaks, quotes and delimiters."""
        df, path = notes(spark, sf_dir, S.NOTE), scratch(spark, "csv-quoted")
        written(df, path)
        return csv_io.load_csv(spark, path, schema=df.schema, multiline=True)

    @register("csv_encodings", S.csv_text_sql(S.ACCENTED))
    def q_csv_encodings(spark, sf_dir):
        """UTF-8 with and without a byte order mark, and Latin-1, in a folder whose name holds a space."""
        df, path = notes(spark, sf_dir, S.ACCENTED), scratch(spark, "csv encodings")
        written(df.where("client_id % 3 = 0"), f"{path}/a")
        written(df.where("client_id % 3 = 1").withColumnRenamed("client_id", "\ufeffclient_id"), f"{path}/b")
        written(df.where("client_id % 3 = 2"), f"{path}/c", encoding="ISO-8859-1", sep="|")
        return csv_io.load_csv(spark, f"{path}/*", schema=df.schema)

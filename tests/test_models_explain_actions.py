"""Models (T1-T14), attribution (X1-X5), actions (A1-A13), sinks."""
import os

import pytest
from pyspark.sql import functions as F

from ebb.functions import fixed as FX
from ebb.operators import actions, explain, models
from ebb.operators.features import engineer_features
from ebb.operators.rfm import compute_rfm
from ebb.operators.scoring import LinearScorer


@pytest.fixture(scope="module")
def trained(sample_df):
    X, names, _ = engineer_features(sample_df)
    rep = models.train_and_compare(
        X, names, cv_folds=2, calibration_folds=2,
        specs=models.default_specs({"Random Forest": {"numTrees": 30}, "XGBoost": {"maxIter": 15}}))
    return X, names, rep


def test_train_and_compare(trained):
    X, names, rep = trained
    rows = rep.metrics.collect()
    assert len(rows) == 3
    assert rep.best_model_name in FX.MODEL_NAMES
    assert rep.best_auc == max(r["auc_roc"] for r in rows)
    assert rep.best_auc > 0.5
    assert rep.importances.where("rank <= 15").count() == rep.importances.count()


def test_hold_out_and_in_sample_metrics(trained):
    X, names, rep = trained
    forest = models.default_specs({"Random Forest": {"numTrees": 30}})[1:2]
    auc = {e: models.train_and_compare(X, names, cv_folds=2, calibration_folds=2, specs=forest, evaluate=e).best_auc
           for e in ("hold_out", "in_sample")}
    assert auc["hold_out"] == {r["model"]: r["auc_roc"] for r in rep.metrics.collect()}["Random Forest"]
    assert auc["in_sample"] > auc["hold_out"]
    with pytest.raises(ValueError):
        models.train_and_compare(X, names, evaluate="all")


def test_model_persistence(trained, tmp_path):
    X, names, rep = trained
    m = rep.models[rep.best_model_name]
    path = str(tmp_path / "model")
    m.write(path)
    assert sum(len(fs) for _, _, fs in os.walk(path)) > 0
    back = models.CalibratedModel.load(path)
    a = m.transform(X, keep=["client_id"]).orderBy("client_id").collect()
    b = back.transform(X, keep=["client_id"]).orderBy("client_id").collect()
    assert all(abs(x["churn_prob"] - y["churn_prob"]) < 1e-12 for x, y in zip(a, b))


def test_permutation_shapley_additivity(trained):
    X, names, rep = trained
    name = "Random Forest"
    fn = explain.model_score_fn(rep.base_models[name], "rf")
    contrib, base = explain.permutation_contributions(fn, X.limit(20), names, permutations=3)
    tot = contrib.groupBy("client_id").agg(F.sum("contribution").alias("s"))
    from pyspark.ml.feature import VectorAssembler
    fx = fn(VectorAssembler(inputCols=names, outputCol="features").transform(X.limit(20)))
    j = tot.join(fx.select("client_id", "score"), "client_id").collect()
    assert len(j) == 20
    assert all(abs(r["s"] - (r["score"] - base)) < 1e-9 for r in j)


def test_linear_exact_equals_permutation(spark, sample_df):
    X, names, _ = engineer_features(sample_df)
    coefs = {n: 0.1 * (i + 1) for i, n in enumerate(names)}
    lin, base = explain.linear_contributions(X, coefs, 0.3)
    scorer = LinearScorer(coefs, 0.3, digits=None)

    def fn(df):
        from pyspark.ml.functions import vector_to_array
        arr = vector_to_array("features")
        m = F.lit(0.3)
        for i, n in enumerate(names):
            m = m + F.lit(coefs[n]) * arr[i]
        return df.withColumn("score", m)
    perm, base2 = explain.permutation_contributions(fn, X, names, permutations=2)
    j = lin.join(perm, ["client_id", "feature"]).select(
        F.max(F.abs(lin.contribution - perm.contribution))).first()[0]
    assert j < 1e-9 and abs(base - base2) < 1e-9
    assert scorer.transform(X).count() == sample_df.count()


def test_generate_recommendations(spark, sample_df):
    rfm = compute_rfm(sample_df)
    probs = rfm.select("client_id", (F.abs(F.hash("client_id")) % 1000 / 1250.0).alias("churn_prob"))
    recs = actions.generate_recommendations(rfm, probs)
    assert recs.count() == sample_df.count()
    assert {"action", "churn_prob", "roi_estimate", "urgency"} <= set(recs.columns)
    top = actions.top_at_risk(recs).collect()
    assert len(top) == 10


def test_unknown_segment_takes_lost_rule(spark):
    df = spark.createDataFrame([("x", "Newcomer", 0.9, 10.0)], "client_id string, rfm_segment string, "
                                                                "churn_prob double, total_revenue double")
    r = actions.generate_recommendations(df).first()
    assert r["action"] == FX.SEGMENT_ACTIONS["Lost"][1]
    # high risk: lift 0.10 * 0.7 -> roi = 10 * (1 - 0.07) * 0.9
    assert r["roi_estimate"] == round(10 * (1 - 0.1 * 0.7) * 0.9, 2)


def test_factor_advice(spark):
    f = spark.createDataFrame([(1, 1, "days_since_last_login"), (1, 2, "nps_score"), (1, 3, "total_orders"),
                               (1, 4, "days_since_last_login"), (1, 5, "return_rate")],
                              "client_id int, rank int, feature string")
    adv = actions.factor_advice(f).first()["advice"]
    assert adv == [FX.FACTOR_ADVICE[0][1], FX.FACTOR_ADVICE[7][1], FX.FACTOR_ADVICE[11][1]]

"""Drift (D1-D5) and metrics."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ebb.operators import drift, metrics


def _normal(spark, mu, seed, n=1000):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(pd.DataFrame({"x": rng.normal(mu, 1, n)}))


def test_psi(spark):
    a, b, c = _normal(spark, 0, 1), _normal(spark, 0, 2), _normal(spark, 3, 3)
    psi = lambda r, k: drift.psi_by_feature(drift.to_long(r, k, ["x"])).first()["psi"]
    assert psi(a, b) < 0.3
    assert psi(a, c) > 0.3
    assert psi(a, a) == 0.0


def test_drift_table_and_alerts(spark):
    a, c = _normal(spark, 0, 1), _normal(spark, 3, 3)
    d = drift.detect_drift(a, c).collect()
    assert d[0]["severity"] == "severe" and d[0]["drift_detected"]
    alerts = [r["alert"] for r in drift.drift_alerts(drift.detect_drift(a, c)).collect()]
    assert any("x" in s for s in alerts)
    none = [r["alert"] for r in drift.drift_alerts(drift.detect_drift(a, a)).collect()]
    assert len(none) == 1 and none[0].startswith("✅")


def test_drift_empty_side_and_no_columns(spark):
    a = _normal(spark, 0, 1)
    r = drift.detect_drift(a, a.where("x > 100"), ["x"]).first()
    assert (r["psi"], r["ks_statistic"], r["ks_p_value"], r["drift_detected"]) == (0.0, 0.0, 1.0, False)
    s = spark.createDataFrame([("a",)], "s string")
    assert drift.detect_drift(s, s).count() == 0


def test_ks_matches_definition(spark):
    a, c = _normal(spark, 0, 1, 300), _normal(spark, 0.5, 4, 200)
    got = drift.ks_by_feature(drift.to_long(a, c, ["x"])).first()["ks_statistic"]
    x, y = np.sort(a.toPandas().x.values), np.sort(c.toPandas().x.values)
    allv = np.concatenate([x, y])
    want = np.max(np.abs(np.searchsorted(x, allv, "right") / len(x) - np.searchsorted(y, allv, "right") / len(y)))
    assert abs(got - want) < 1e-12


def test_roc_auc_ties_and_threshold(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "label int, score double")
    assert metrics.auc(df).first()["auc"] == 0.5
    roc = sorted(metrics.roc_points(df).collect(), key=lambda r: -r["threshold"])
    assert (roc[0]["fpr"], roc[0]["tpr"]) == (0.0, 0.0) and (roc[-1]["fpr"], roc[-1]["tpr"]) == (1.0, 1.0)
    d2 = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.3), (0, 0.2)], "label int, score double")
    assert abs(metrics.auc(d2).first()["auc"] - 5 / 6) < 1e-12
    best = metrics.optimal_threshold(d2).first()
    # threshold 0.3 catches all positives with one false positive: cost 1
    assert (best["threshold"], best["cost"]) == (0.3, 1.0)
    cm = metrics.classification_metrics(d2.withColumn("prediction", (F.col("score") > 0.5).cast("int"))).first()
    assert (cm["precision"], cm["recall"], cm["accuracy"]) == (0.6667, 0.6667, 0.6)

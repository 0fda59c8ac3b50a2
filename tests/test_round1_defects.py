"""Cases that once crashed or lost rows."""
import pytest
from pyspark.sql import functions as F

from ebb.operators import drift, explain, features, models
from ebb.operators.repair import auto_fix_dataframe
from ebb.session import ensure_checkpoint_dir


def test_halves_hold_rows_without_a_key(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    one, two = drift.split_halves(df, "k")
    assert one.count() + two.count() == 3


def test_all_null_date_stays_null(spark):
    df = spark.range(6).select(F.col("id").cast("string").alias("name"), F.lit(None).cast("date").alias("day"),
                               F.col("id").cast("double").alias("amount"))
    assert auto_fix_dataframe(df).where("day is null").count() == 6


def test_all_null_string_is_filled(spark):
    df = spark.range(6).select("id", F.lit(None).cast("string").alias("note"))
    assert {r["note"] for r in auto_fix_dataframe(df).collect()} == {"UNKNOWN"}


def test_category_with_a_dot_trains_and_scores(spark):
    rows = [(i, ["v1.0", "v2.0", "v3.0"][i % 3], float(i % 7), int(i % 3 == 0 or i % 7 > 4)) for i in range(90)]
    df = spark.createDataFrame(rows, "client_id int, `app.version` string, visits double, churned int")
    X, names, _ = features.engineer_features(df)
    assert {"app.version_v2.0", "app.version_v3.0"} < set(names)
    rep = models.train_and_compare(X, names, cv_folds=2, calibration_folds=2, specs=models.default_specs()[:1])
    p = [r["churn_prob"] for r in models.predict_churn(rep.models["Logistic Regression"], X).collect()]
    assert len(p) == 90 and all(0 <= x <= 1 for x in p)


def test_fallback_importance():
    ranked, base = explain.fallback_importance([("a", 0.1), ("b", 0.1234567), ("c", 0.0)], top=2)
    assert ranked == [("b", 0.123457), ("a", 0.1)] and base == 0.5


def test_score_space():
    assert [explain.score_space(k) for k in ("lr", "rf", "gbt")] == ["margin", "probability", "probability"]


def test_ratio_pairs():
    cols = ["support_tickets", "tenure_months", "total_revenue", "total_orders", "return_count", "return_rate"]
    assert features.ratio_pairs(cols, cols) == [
        ("support_tickets", "tenure_months", "ratio_support_tickets_per_tenure_months"),
        ("total_revenue", "total_orders", "ratio_total_revenue_per_total_orders"),
        ("return_count", "total_orders", "ratio_return_count_to_total_orders")]


def test_no_local_scratch_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())

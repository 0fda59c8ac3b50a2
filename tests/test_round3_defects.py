"""Defects reported in round 3."""
import pytest
from pyspark.sql import functions as F

from ebb.functions.exprs import bin_by_cuts, bin_by_edges, bin_cuts
from ebb.operators import lifecycle, models
from ebb.plans import catalog


@pytest.fixture
def fits(monkeypatch):
    """Kinds of the models in the order in which their fits begin."""
    began, estimator = [], models.ModelSpec.estimator
    monkeypatch.setattr(models.ModelSpec, "estimator",
                        lambda spec, *a: began.append(spec.kind) or estimator(spec, *a))
    return began


def test_a_result_waits_only_for_the_fits_it_needs(spark, fits):
    rows = [(i, float(i % 7), float(i * 3 % 11), int(i % 7 + i * 3 % 11 > 8)) for i in range(120)]
    X = spark.createDataFrame(rows, "client_id long, a double, b double, churned int")
    specs = models.default_specs({"Random Forest": {"numTrees": 3, "maxDepth": 3}, "XGBoost": {"maxIter": 2}})
    rep = models.train_and_compare(X, ["a", "b"], cv_folds=3, calibration_folds=2, specs=specs)
    assert len(rep.base_models["Logistic Regression"].coefficients) == 2
    assert fits == ["lr"]
    best = rep.best_model_name
    assert sorted(fits) == ["gbt"] * 2 + ["lr"] * 3 + ["rf"] * 2      # two folds of each model
    assert rep.models[best].transform(X, keep=["client_id"]).count() == 120
    assert rep.importances.select("model").distinct().count() == 3
    assert sorted(fits) == ["gbt"] * 3 + ["lr"] * 3 + ["rf"] * 3
    metrics = {r["model"]: r for r in rep.metrics.collect()}
    assert sorted(fits) == ["gbt"] * 6 + ["lr"] * 6 + ["rf"] * 6      # and three folds of CV
    assert metrics[best]["auc_roc"] == rep.best_auc
    own = {r["model"]: r for r in rep.evaluation.collect()}
    for name, row in metrics.items():
        assert 0 <= row["cv_auc_mean"] <= 1 and row["train_time_sec"] >= 0
        assert all(row[c] == own[name][c] for c in rep.evaluation.columns)
    assert rep.roc.select("model").distinct().count() == 3
    rep.metrics, rep.models, rep.importances
    assert len(fits) == 18


def test_training_needs_both_classes_in_every_fold(spark):
    rows = [(i, float(i), int(i == 3)) for i in range(20)]
    X = spark.createDataFrame(rows, "client_id long, a double, churned int")
    with pytest.raises(ValueError, match="fold lacks one of the classes"):
        models.train_and_compare(X, ["a"], cv_folds=2, calibration_folds=2)
    with pytest.raises(ValueError, match="both classes"):
        models.train_and_compare(X.withColumn("churned", F.lit(0)), ["a"], cv_folds=2, calibration_folds=2)


def test_bins_by_cuts_are_those_by_edges(spark):
    edges = [[0.0, 1.0, 2.0, 3.0, 4.0], [1.0, 1.0, 1.0, 2.0, 9.0], [5.0] * 5, [-3.0, 0.1, 0.2, 0.2, 0.7]]
    values = [-4.0, -3.0, -0.5, 0.0, 0.1, 0.2, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 7.0, 9.0, 10.0]
    df = spark.createDataFrame([(v, e) for e in edges for v in values], "v double, e array<double>")
    cuts = df.withColumns({f"c{i}": c for i, c in enumerate(bin_cuts(F.col("e")))})
    both = cuts.select(bin_by_edges(F.col("v"), F.col("e")).alias("a"),
                       bin_by_cuts(F.col("v"), [F.col(f"c{i}") for i in range(3)]).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and {r["a"] for r in both} == {1, 2, 3, 4}


def test_monthly_segments_finds_cuts_once_per_month(spark):
    orders = spark.range(400).selectExpr(
        "id % 40 AS o_custkey", "timestamp_seconds(1.5e9 + id * 2e5) AS o_orderdate", "id * 7 % 31 + 0.5D AS o_totalprice")
    out = lifecycle.monthly_segments(orders)
    per_client, per_month = out._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    assert "array_distinct" not in per_client and "array_distinct" in per_month
    assert out.select("segment").distinct().count() > 2


def test_platt_takes_known_counts(spark):
    rows = [(i / 40.0, float(i % 5 > 1 or i > 25)) for i in range(40)]
    scores = spark.createDataFrame(rows, "s double, label double").repartition(8)
    counts = {y: sum(1 for _, own in rows if own == y) for y in (0.0, 1.0)}
    assert models.platt(scores, counts=counts) == pytest.approx(models.platt(scores), rel=1e-6)


def test_training_features_are_dealt_out(spark):
    X = catalog.training(spark, "/root/testdata/sf0.001")[2]
    assert len(X.inputFiles()) >= min(4, spark.sparkContext.defaultParallelism)
    assert X.count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()

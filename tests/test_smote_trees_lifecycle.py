"""Neighbours, SMOTE, tree attributions and clients over time against plain versions."""
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebb.operators import explain, lifecycle, models, neighbours, smote, tree_explain


# --- neighbours and SMOTE --------------------------------------------------------

def plain_neighbours(rows, k):
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows])
    d = neighbours.squared_distances(x, x)
    return sorted((i, n + 1, j, math.sqrt(v)) for a, i in enumerate(ids)
                  for n, (v, j) in enumerate(sorted((d[a, b], j) for b, j in enumerate(ids) if b != a)[:k]))


@pytest.mark.parametrize("n,dim,k,block", [(300, 3, 5, 16), (200, 2, 3, 2048), (3, 2, 5, 8), (1, 1, 5, 8)])
def test_neighbours_are_exact(spark, monkeypatch, n, dim, k, block):
    """Ties, a third of the rows equal, cells of several blocks, fewer rows than neighbours."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    x = np.round(np.random.default_rng(n).standard_normal((n, dim)), 1)
    x[:n // 3] = x[0]
    rows = [(i * 3, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(10 ** 6, None), (10 ** 6 + 1, [float("nan")] * dim), (10 ** 6 + 2, [None] * dim)]
    df = spark.createDataFrame(rows + odd, "client_id long, x array<double>").repartition(3)
    assert sorted(map(tuple, neighbours.nearest_neighbours(df, k).collect())) == plain_neighbours(rows, k)


def test_neighbours_of_none(spark):
    none = spark.createDataFrame([], "client_id long, x array<double>")
    assert neighbours.nearest_neighbours(none, 5).collect() == []


def test_smote_rows_lie_between_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.standard_normal((20, 3)))]
    df = spark.createDataFrame(rows, "client_id long, x array<double>")
    new = smote.smote_rows(df, 47).collect()
    near = {(a, b) for a, _, b, _ in plain_neighbours(rows, 5)}
    x = dict(rows)
    assert len(new) == 47
    assert sorted({r["client_id"]: 0 for r in new}) == list(range(20))        # dealt out evenly
    for r in new:
        assert (r["client_id"], r["neighbour"]) in near and 0 <= r["gap"] < 1
        a, b = np.array(x[r["client_id"]]), np.array(x[r["neighbour"]])
        assert np.allclose(r["x"], a + r["gap"] * (b - a))
    again = smote.smote_rows(df.repartition(7), 47).collect()
    assert sorted(map(str, again)) == sorted(map(str, new))


def test_oversample_balances(spark):
    rows = [(i, 1.0 if i < 4 else 0.0, [float(i), 1.0]) for i in range(15)]
    df = spark.createDataFrame(rows, "client_id long, label double, x array<double>")
    got = smote.oversample(df)
    assert {r[0]: r[1] for r in got.groupBy("label").count().collect()} == {0.0: 11, 1.0: 11}
    lonely = spark.createDataFrame([(0, 1.0, [5.0]), (1, 0.0, [1.0]), (2, 0.0, [2.0])], df.schema)
    assert sorted(r["x"] for r in smote.oversample(lonely).where("label = 1").collect()) == [[5.0], [5.0]]
    with pytest.raises(ValueError):
        smote.oversample(df.where("label = 0"))


def test_training_with_smote(sample_df):
    from ebb.operators.features import engineer_features
    X, names, _ = engineer_features(sample_df.withColumn("client_id", F.expr("cast(substr(client_id, 2) as long)")))
    spec = [models.ModelSpec("Logistic Regression", "lr")]
    rep = models.train_and_compare(X, names, specs=spec, cv_folds=2, calibration_folds=2, use_smote=True)
    row = rep.metrics.first()
    assert 0 <= row["auc_roc"] <= 1 and row["cv_auc_mean"] > 0
    assert rep.n_samples == X.count()


# --- tree attributions -------------------------------------------------------------

def plain_value(tree, x, known, i=0):
    if tree.left[i] < 0:
        return tree.value[i]
    a, b = tree.left[i], tree.right[i]
    if tree.feature[i] in known:
        return plain_value(tree, x, known, a if x[tree.feature[i]] <= tree.threshold[i] else b)
    return (tree.cover[a] * plain_value(tree, x, known, a) + tree.cover[b] * plain_value(tree, x, known, b)) / tree.cover[i]


def plain_attribution(trees, x):
    m = len(x)
    out = np.zeros(m)
    for i in range(m):
        for size in range(m):
            w = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
            for s in itertools.combinations([j for j in range(m) if j != i], size):
                out[i] += w * sum(plain_value(t, x, {*s, i}) - plain_value(t, x, set(s)) for t in trees)
    return out


def random_tree(rng, depth, m):
    if depth == 0 or rng.random() < 0.15:
        return (float(rng.standard_normal()), int(rng.integers(1, 40)))
    return (int(rng.integers(m)), float(rng.standard_normal()), random_tree(rng, depth - 1, m), random_tree(rng, depth - 1, m))


@pytest.mark.parametrize("depth", [0, 1, 2, 5, 8])
def test_attributions_equal_enumeration(depth):
    rng = np.random.default_rng(depth)
    trees = [tree_explain.tree_of(random_tree(rng, depth, 4), 0.7) for _ in range(3)]
    x = rng.standard_normal((12, 4))
    got = tree_explain.tree_attributions(trees, x)
    assert np.allclose(got, [plain_attribution(trees, r) for r in x], atol=1e-12)
    total = [sum(plain_value(t, r, set(range(4))) for t in trees) - sum(t.mean() for t in trees) for r in x]
    assert np.allclose(got.sum(axis=1), total)


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.range(600).select(
        F.col("id").alias("client_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b.c"),
        F.sin(F.col("id").cast("double")).alias("c"), F.when(F.col("id") % 13 != 0, F.col("id") % 5).cast("double").alias("d"))
    df = df.withColumn("label", ((F.col("a") + F.col("`b.c`") * F.col("c")) > 3).cast("double"))
    names = ["a", "b.c", "c", "d"]
    train = models.with_features(df.fillna(0.0), names).withColumn("w", F.col("a") + 1)
    rf = RandomForestClassifier(numTrees=7, maxDepth=5, seed=3, weightCol="w").fit(train)
    gbt = GBTClassifier(maxIter=6, maxDepth=3, stepSize=0.3, weightCol="w", seed=3).fit(train)
    return df, names, train, rf, gbt


def test_attributions_of_fitted_models(fitted):
    df, names, train, rf, gbt = fitted
    for model, kind in ((rf, "rf"), (gbt, "gbt")):
        e = explain.explain_model(model, kind, df, names, [])
        assert e.method == "tree"
        c = e.contributions.groupBy("client_id").agg(F.sum("contribution").alias("t"))
        out = vector_to_array("probability")[1]
        out = F.log(out / (1 - out)) if kind == "gbt" else out
        both = model.transform(train).select("client_id", out.alias("f")).join(c, "client_id").toPandas()
        assert len(both) == 600 and np.allclose(both["f"], both["t"] + e.base_value, atol=1e-9)
        trees = tree_explain.forest_of(model)
        x = np.array(train.orderBy("client_id").limit(3).select(vector_to_array("features")).collect(), dtype=float)[:, 0]
        phi = {(r["client_id"], r["ordinal"]): r["contribution"] for r in e.contributions.where("client_id < 3").collect()}
        for i, row in enumerate(x):
            assert np.allclose([phi[i, j] for j in range(4)], plain_attribution(trees, row), atol=1e-9)


def test_importances_stand_in(fitted):
    df, names, _, rf, _ = fitted
    e = explain.explain_model(object(), "svm", df, names, [("a", 0.25), ("c", 0.5)])
    assert (e.method, e.base_value) == ("importances", 0.5)
    assert [tuple(r) for r in e.importance.collect()] == [("c", 0.5), ("a", 0.25)]
    assert e.contributions.agg(F.count("*"), F.max(F.abs("contribution"))).first()[:] == (2400, 0.0)
    with pytest.raises(ValueError):
        tree_explain.forest_of(rf, max_nodes=10)


# --- clients over time -----------------------------------------------------------------

EVENTS = "user_id long, ts timestamp_ntz, value double"


@pytest.fixture(scope="module")
def events(spark):
    rows = [(1, d, 2.5) for d in ("2024-01-01 10:00:00", "2024-01-01 11:00:00", "2024-01-20 00:00:00", "2024-03-31 23:59:59")]
    rows += [(2, "2024-01-05 00:00:00", None), (3, "2024-03-25 00:00:00", 1.0), (None, "2024-01-02 00:00:00", 9.0), (4, None, 9.0)]
    df = spark.createDataFrame(rows, "user_id long, ts string, value double")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_horizons(events):
    got = {(r["user_id"], str(r["snapshot"])): r for r in lifecycle.horizon_labels(events).collect()}
    assert {s for _, s in got} <= {str(np.datetime64("2024-03-31") - 7 * i) for i in range(14)}
    r = got[1, "2024-01-07"]
    assert (r["n_events"], r["active_days"], r["value_sum"], r["days_since_last"]) == (2, 1, 5.0, 6)
    assert [r[f"churn_{h}"] for h in (7, 14, 30, 60)] == [1, 0, 0, 0] and r["churn_90"] is None
    assert got[2, "2024-01-07"]["value_sum"] == 0.0 and got[2, "2024-01-07"]["churn_60"] == 1
    assert got[1, "2024-03-31"]["n_events"] == 1 and got[1, "2024-03-31"]["churn_7"] is None
    assert (1, "2024-02-25") not in got                      # nothing in its look-back
    assert lifecycle.horizon_labels(events.where("false")).collect() == []


def test_lags_and_trend(events):
    got = [r for r in lifecycle.lag_trend_features(events).orderBy("user_id", "period").collect() if r["user_id"] == 1]
    n = [r["n"] for r in got]
    assert sum(n) == 4 and n[0] == 2 and len(n) == 14        # weeks without events are zeros
    for i, r in enumerate(got):
        assert r["n_lag_1"] == (n[i - 1] if i else None) and r["n_lag_4"] == (n[i - 4] if i >= 4 else None)
        y = n[max(0, i - 3):i + 1]
        want = np.polyfit(range(len(y)), y, 1)[0] if len(y) > 1 else None
        assert (r["trend"] is None) == (want is None) and (want is None or abs(r["trend"] - want) < 1e-9)
    assert got[1]["direction"] == "falling" and got[0]["direction"] is None
    assert lifecycle.lag_trend_features(events.where("false")).collect() == []


def test_transitions_account_for_every_client(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    segs = lifecycle.monthly_segments(orders).cache()
    moves = lifecycle.segment_transitions(segs).toPandas()
    per_month = {str(r["month"]): r["n"] for r in segs.groupBy("month").agg(F.count("*").alias("n")).collect()}
    for month, g in moves.groupby("month"):
        before = str((np.datetime64(str(month), "M") - 1).astype("datetime64[D]"))
        assert g.loc[g["from_segment"] != "absent", "clients"].sum() == per_month[before]
        assert g.loc[g["to_segment"] != "absent", "clients"].sum() == per_month[str(month)]
        assert np.allclose(g.groupby("from_segment")["share"].sum(), 1)
    assert lifecycle.segment_transitions(lifecycle.monthly_segments(orders.where("false"))).collect() == []

"""Defects reported in round 4."""
import re

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ebb.operators import explain, models, tree_explain


@pytest.fixture(scope="module")
def small_forest(spark):
    df = spark.range(200).selectExpr("id AS client_id", "double(id % 7) AS a", "double(id % 3) AS b",
                                     "double(id % 7 + id % 3 > 5) AS label")
    return df, RandomForestClassifier(numTrees=3, maxDepth=3, seed=1).fit(models.with_features(df, ["a", "b"]))


def test_a_failed_attribution_is_no_result(spark, small_forest, monkeypatch):
    """it came out as contributions of 0."""
    df, rf = small_forest
    assert explain.explain_model(rf, "rf", df, ["a", "b"], []).method == "tree"
    coded = df.withColumn("b", F.col("b").alias("b", metadata={"ml_attr": {"type": "nominal", "vals": ["x", "y", "z"], "name": "b"}}))
    nominal = RandomForestClassifier(numTrees=3, maxDepth=3, seed=1).fit(
        VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(coded))
    with pytest.raises(ValueError, match="categorical"):
        explain.explain_model(nominal, "rf", df, ["a", "b"], [("a", 1.0)])
    monkeypatch.setattr(tree_explain, "forest_of", lambda *a: (_ for _ in ()).throw(ValueError("broken")))
    with pytest.raises(ValueError, match="broken"):
        explain.explain_model(rf, "rf", df, ["a", "b"], [("a", 1.0)])


def test_forests_of_any_size_are_explained(small_forest):
    """a forest above a fixed number of nodes was not."""
    _, rf = small_forest
    limits = [f.__defaults__ for f in (tree_explain.forest_of, tree_explain.tree_contributions)]
    assert limits == [(None,), ("client_id", None)]
    assert sum(len(t.left) for t in tree_explain.forest_of(rf)) == rf.totalNumNodes


class CountedNumpy:
    """numpy, with the entries that ``where`` has judged."""
    judged = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def where(self, condition, *values):
        self.judged += condition.size
        return np.where(condition, *values)


def grown_tree(rng, depth, features):
    if depth == 0 or rng.random() < 0.1:
        return (float(rng.standard_normal()), int(rng.integers(1, 40)))
    return (int(rng.integers(features)), float(rng.standard_normal()),
            grown_tree(rng, depth - 1, features), grown_tree(rng, depth - 1, features))


def test_tree_attributions_are_made_once_per_outcome(monkeypatch):
    """the products were made for every row at every node."""
    rng = np.random.default_rng(5)
    tree = tree_explain.tree_of(grown_tree(rng, 6, 8))
    rows = rng.integers(-2, 3, size=(50, 8)).astype(float)
    x = np.tile(rows, (400, 1))
    counted = CountedNumpy()
    monkeypatch.setattr(tree_explain, "np", counted)
    got = tree_explain.tree_attributions([tree], x)
    assert counted.judged < len(x)
    assert np.allclose(got, np.tile(tree_explain.tree_attributions([tree], rows), (400, 1)), atol=1e-12)


@pytest.mark.parametrize("bits", [0, 3, 6, 20])
def test_tree_attributions_do_not_depend_on_the_cut(monkeypatch, bits):
    rng = np.random.default_rng(bits)
    trees = [tree_explain.tree_of(grown_tree(rng, depth, 5)) for depth in (0, 3, 8)]
    x = rng.standard_normal((300, 5))
    x[::7, 2] = np.nan
    want = tree_explain.tree_attributions(trees, x)
    monkeypatch.setattr(tree_explain, "STATE_BITS", bits)
    assert np.allclose(tree_explain.tree_attributions(trees, x), want, atol=1e-12)


def test_forest_fits_keep_node_numbers(spark, small_forest):
    """Every level of a forest walked all of its trees from the root."""
    df, _ = small_forest
    train = models.with_weights(models.with_features(df, ["a", "b"]))
    small = {"numTrees": 8, "maxDepth": 4, "minInstancesPerNode": 2}
    kept = models.ModelSpec("Random Forest", "rf", small).estimator(200, "")
    walked = models.ModelSpec("Random Forest", "rf", {**small, "cacheNodeIds": False, "checkpointInterval": 10}).estimator(200, "")
    assert kept.getCacheNodeIds() and not walked.getCacheNodeIds()
    assert kept.fit(train).toDebugString.split("\n", 1)[1] == walked.fit(train).toDebugString.split("\n", 1)[1]
    # 18 partitions for 900,000 clients sent 18 histograms of each node
    assert max(models.FIT_PARTITIONS, -(-900_000 // models.FIT_ROWS)) == 4


def test_permutations_sort_no_arrays(spark, small_forest):
    """the window sorted the order of all features with every score."""
    df, rf = small_forest
    contribs, _ = explain.permutation_contributions(explain.model_score_fn(rf, "rf"), df, ["a", "b"], permutations=2)
    plan = contribs._jdf.queryExecution().executedPlan().toString()
    windowed = re.search(r"Window \[.*", plan).group()
    assert "order" not in windowed
    below = re.search(r"Window \[[^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Project \[([^\n]*)", plan).group(1)
    assert "ordinal" in below and not re.search(r"\border#\d+(,|\])", below)
    assert "Generate" not in plan[plan.index("Exchange hashpartitioning(client_id"):]     # dealt out before they expand
    assert contribs.count() == 400

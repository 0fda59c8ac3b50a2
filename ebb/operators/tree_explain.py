"""Exact attributions of tree ensembles (X1), dependent on the paths' covers.

A leaf of value v whose path tests m features credits feature i with::

    v * (o_i - z_i) * sum over subsets S of the others of |S|! (m-|S|-1)! / m! * prod(S: o_j) * prod(not S: z_j)

where o_j says whether the row passes all tests of feature j on the path and z_j
is the share of training weight that does. The weights are integrals of ``t^|S|
(1-t)^(m-1-|S|)`` over [0, 1], so the sum is the integral of the polynomial
``prod(t o_j + (1-t) z_j)`` over the other features. Its degree is below the
depth, hence Gauss-Legendre nodes integrate it without error: one product per
node, no enumeration of subsets. The products are extended edge by edge on the way
down and summed over leaves on the way up. A tree is cut into subtrees so small that their
tests, with those of the path above by feature, have at most 2^STATE_BITS outcomes. The
sums are made once for each outcome that a batch of rows has, not for each row, and each row takes
its outcome's, so the work by rows is subtrees x rows x (tests + features).

The forest is flattened into arrays of nodes, which are broadcast, as Spark does with
the model itself to score rows (the model's nodes take more memory than the arrays). Rows
stream through in Arrow batches and are multiplied by nothing. Contributions add up to ``f(x) - base`` where the base is the cover-weighted mean.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..session import ensure_checkpoint_dir

BATCH = 65_536
#: Tests of the path and of a subtree that are taken together: the rows of a batch have few of
#: their 2^STATE_BITS outcomes.
STATE_BITS = 12


@dataclass
class Tree:
    """Arrays over the nodes; ``left`` is -1 at a leaf. Rows with ``x[feature] <=
    threshold`` go left."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    def depth(self, i: int = 0) -> int:
        return 0 if self.left[i] < 0 else 1 + max(self.depth(self.left[i]), self.depth(self.right[i]))

    def share(self, child: int, parent: int) -> float:
        return max(float(self.cover[child] / self.cover[parent]), 1e-12)

    def mean(self, i: int = 0) -> float:
        if self.left[i] < 0:
            return float(self.value[i])
        a, b = self.left[i], self.right[i]
        return self.share(a, i) * self.mean(a) + self.share(b, i) * self.mean(b)


def is_ensemble(model) -> bool:
    """Whether :func:`forest_of` knows models of this type."""
    from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
    return isinstance(model, (GBTClassificationModel, RandomForestClassificationModel))


def forest_of(model, max_nodes: int | None = None) -> list[Tree]:
    """The trees of a fitted Spark ML forest or boosted classifier, read from its
    saved node table. Leaf values are weighted so that their sum is the
    probability of class 1 (forest) or its log-odds (boosting). More than
    ``max_nodes`` nodes, where given, are an error."""
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if not is_ensemble(model):
        raise TypeError(f"no tree ensemble: {type(model).__name__}")
    if max_nodes is not None and model.totalNumNodes > max_nodes:
        raise ValueError(f"{model.totalNumNodes} nodes are more than {max_nodes}")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ebb-tables/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    boosted = isinstance(model, GBTClassificationModel)
    stats = F.col("n.impurityStats")
    # boosting keeps (weight, sum, sum of squares) per node, a forest the weight of each class
    cover = stats[0] if boosted else F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    value = F.col("n.prediction") if boosted else F.coalesce(F.try_divide(stats[1], cover), F.lit(0.0))
    nodes = spark.read.parquet(f"{path}/data").select("treeID", F.col("nodeData").alias("n")).select(
        "treeID", F.col("n.id").alias("id"), F.col("n.split.featureIndex").alias("feature"),
        F.get("n.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("n.split.numCategories").alias("levels"),
        F.col("n.leftChild").alias("left"), F.col("n.rightChild").alias("right"), cover.alias("cover"), value.alias("value"))
    table = nodes.toPandas().sort_values(["treeID", "id"])     # the model's nodes, which the driver holds anyway
    if (table["levels"] >= 0).any():
        raise ValueError("categorical splits are not explained")
    weights = np.asarray(model.treeWeights, dtype=float)
    weights = 2.0 * weights if boosted else weights / weights.sum()
    out = []
    for t, g in table.groupby("treeID"):
        assert (g["id"].to_numpy() == np.arange(len(g))).all()
        out.append(Tree(g["feature"].to_numpy(), g["threshold"].to_numpy(dtype=float), g["left"].to_numpy(),
                        g["right"].to_numpy(), g["cover"].to_numpy(), g["value"].to_numpy() * weights[t]))
    return out


def tree_attributions(trees: Sequence[Tree], x: np.ndarray) -> np.ndarray:
    """Contributions, one row per row of ``x`` and a column per feature."""
    columns = np.ascontiguousarray(x.T)
    phi = np.zeros_like(columns)
    for tree in trees:
        nodes, weights = np.polynomial.legendre.leggauss(max(1, math.ceil(tree.depth() / 2)))
        _attribute(tree, columns, (nodes + 1) / 2, weights / 2, phi)
    return np.ascontiguousarray(phi.T)


def _attribute(tree: Tree, x: np.ndarray, t: np.ndarray, weights: np.ndarray, phi: np.ndarray) -> None:
    """Adds one tree's contributions; ``x`` and ``phi`` have a row per feature."""
    inner = np.zeros(len(tree.left), dtype=int)       # tests in the subtree; children come after their parent
    for i in range(len(inner) - 1, -1, -1):
        if tree.left[i] >= 0:
            inner[i] = 1 + inner[tree.left[i]] + inner[tree.right[i]]

    def factors(o: np.ndarray, z: float) -> tuple[np.ndarray, np.ndarray]:
        on, off = t + (1 - t) * z, (1 - t) * z                # the factor of rows that pass, and of others
        return np.where(o[:, None], on, off), np.where(o[:, None], (1 - z) / on, -z / off)

    def descend(i: int, path: dict) -> None:
        """``path``: feature -> (whether a row passes all its tests above, share of the cover that does)."""
        if tree.left[i] < 0 or len(path) + inner[i] <= STATE_BITS:
            return block(i, path)
        f = tree.feature[i]
        goes = x[f] <= tree.threshold[i]
        passed, share = path.get(f, (True, 1.0))
        for child, taken in ((tree.left[i], goes), (tree.right[i], ~goes)):
            descend(child, {**path, f: (passed & taken, share * tree.share(child, i))})

    def block(top: int, path: dict) -> None:
        """Contributions of the leaves below ``top``, once for each state that rows have in its tests."""
        tests, todo = [], [top]
        while todo:
            i = todo.pop()
            if tree.left[i] >= 0:
                tests.append(i)
                todo += (tree.right[i], tree.left[i])
        bits = [passed for passed, _ in path.values()] + [x[tree.feature[i]] <= tree.threshold[i] for i in tests]
        state = np.zeros(x.shape[1], dtype=np.int64)
        for k, bit in enumerate(bits):
            state += bit * np.int64(1 << k)
        if len(bits) <= STATE_BITS:
            states = np.flatnonzero(np.bincount(state, minlength=1 << len(bits)))
            place = np.zeros(1 << len(bits), dtype=np.int64)
            place[states] = np.arange(len(states))
            place = place[state]
        else:
            states, place = np.unique(state, return_inverse=True)
        passes = [(states >> k & 1).astype(bool) for k in range(len(bits))]
        goes_left = dict(zip(tests, passes[len(path):], strict=True))
        credits: dict = {}

        def credit(f: int, amount: np.ndarray) -> None:
            credits[f] = credits.get(f, 0.0) + amount @ weights

        def visit(i: int, product: np.ndarray, seen: dict) -> np.ndarray:
            """Sum over the leaves below of value times the product of their features' factors."""
            if tree.left[i] < 0:
                return tree.value[i] * product
            f, total = tree.feature[i], 0.0
            passed, share, factor, gained = seen.get(f, (True, 1.0, 1.0, 0.0))
            for child, taken in ((tree.left[i], goes_left[i]), (tree.right[i], ~goes_left[i])):
                o, z = passed & taken, share * tree.share(child, i)
                own, gain = factors(o, z)
                below = visit(child, product * (own / factor), {**seen, f: (o, z, own, gain)})
                credit(f, (gain - gained) * below)
                total = total + below
            return total

        seen = {f: (o, z, *factors(o, z)) for (f, (_, z)), o in zip(path.items(), passes)}
        product = np.ones((len(states), len(t)))
        for _, _, own, _ in seen.values():
            product = product * own
        total = visit(top, product, seen)
        for f, (_, _, _, gain) in seen.items():
            credit(f, gain * total)
        for f, amount in credits.items():
            phi[f] += amount[place]

    descend(0, {})


def contributions_of(trees: Sequence[Tree], X: DataFrame, features: Sequence[str], key: str = "client_id"
                     ) -> tuple[DataFrame, float]:
    """``(key, ordinal, feature, contribution)`` for every row and feature, and
    the base value. Null features count as 0, as elsewhere in this package."""
    features = list(features)
    shared = X.sparkSession.sparkContext.broadcast(list(trees))     # smaller than the model
    rows = X.select(key, F.array(*[F.coalesce(col(f).cast("double"), F.lit(0.0)) for f in features]).alias("x"))

    def run(batches):
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= BATCH:
                yield solve(pd.concat(held))
                held, size = [], 0
        if size:
            yield solve(pd.concat(held))

    def solve(pdf):
        phi = tree_attributions(shared.value, np.stack(pdf["x"].to_list()).astype(float))
        return pd.DataFrame({key: pdf[key].to_numpy(), "phi": list(phi)})

    kind = X.schema[key].dataType.simpleString()
    parts = max(X.sparkSession.sparkContext.defaultParallelism, math.ceil(X.count() / BATCH))
    out = rows.repartition(parts, key).mapInPandas(run, f"`{key}` {kind}, phi array<double>")
    names = F.array(*[F.lit(f) for f in features])
    out = out.select(key, F.posexplode("phi").alias("ordinal", "contribution")).select(
        key, "ordinal", names[F.col("ordinal")].alias("feature"), "contribution")
    return out, float(sum(t.mean() for t in trees))


def tree_contributions(model, X: DataFrame, features: Sequence[str], key: str = "client_id",
                       max_nodes: int | None = None) -> tuple[DataFrame, float]:
    """:func:`contributions_of` a fitted Spark ML tree ensemble."""
    return contributions_of(forest_of(model, max_nodes), X, features, key)


def tree_of(nested, weight: float = 1.0) -> Tree:
    """A tree from ``(feature, threshold, left, right)`` and leaves ``(value, cover)``."""
    rows: list[list] = []

    def add(node) -> float:
        at = len(rows)
        rows.append([])
        if len(node) == 2:
            rows[at] = [-1, 0.0, -1, -1, float(node[1]), float(node[0]) * weight]
            return rows[at][4]
        f, threshold, left, right = node
        a = len(rows)
        cover = add(left)
        b = len(rows)
        cover += add(right)
        rows[at] = [f, float(threshold), a, b, cover, 0.0]
        return cover

    add(nested)
    f, th, left, right, cover, value = zip(*rows, strict=True)
    return Tree(np.array(f), np.array(th), np.array(left), np.array(right), np.array(cover), np.array(value))

"""K-means segmentation of clients.

Seeding is k-means‖ (Bahmani et al., 2012): a few rounds draw rows with a
probability in proportion to their squared distance from the centres so far, by
a hash of the key instead of a random number, and the weighted draws are reduced
to k centres. A Lloyd round is one aggregation of partial sums per cluster, so
the driver sees k rows, and rows are never shuffled. Distances are expressions,
evaluated in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Centres = Sequence[Sequence[float]]


def nearest(features: Sequence[str], centres: Centres) -> Column:
    """struct(d2, cluster) of the nearest centre; ties go to the lower number."""
    def d2(c):
        terms = [(F.col(f) - F.lit(float(v))) * (F.col(f) - F.lit(float(v))) for f, v in zip(features, c, strict=True)]
        return sum(terms[1:], terms[0])

    return F.array_min(F.array(*[F.struct(d2(c).alias("d2"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]))


def seed_centres(df: DataFrame, features: Sequence[str], k: int, key: str = "client_id", rounds: int = 4,
                 seed: int = 42) -> list[list[float]]:
    """k starting centres (fewer if there are fewer distinct rows). About
    ``2 k`` rows are drawn per round, so candidates are bounded by the parameters."""
    base = df.select(key, *[F.col(f).cast("double").alias(f) for f in features])
    first = base.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(1).collect()
    if not first:
        return []
    centres = [[r[f] for f in features] for r in first]
    for r in range(rounds):
        d = base.withColumn("d2", nearest(features, centres)["d2"])
        cost = d.agg(F.sum("d2")).first()[0] or 0.0
        if cost <= 0:
            break
        u = F.pmod(F.xxhash64(F.col(key), F.lit(seed + r + 1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        drawn = d.where(u < F.lit(2.0 * k / cost) * F.col("d2")).select(*features).distinct().collect()
        centres += [[row[f] for f in features] for row in drawn]
    x = np.unique(np.array(centres, dtype=float), axis=0)
    weights = np.zeros(len(x))
    for row in base.select(nearest(features, x.tolist())["cluster"].alias("c")).groupBy("c").count().collect():
        weights[row["c"]] = row["count"]
    picked = [int(weights.argmax())]
    while len(picked) < min(k, len(x)):
        d2 = ((x[:, None] - x[None, picked]) ** 2).sum(axis=2).min(axis=1) * weights
        if d2.max() <= 0:
            break
        picked.append(int(d2.argmax()))
    return x[picked].tolist()


def kmeans_fit(df: DataFrame, features: Sequence[str], centres: Centres, rounds: int = 20,
               tolerance: float = 0.0) -> tuple[list[list[float]], list[float]]:
    """(centres, inertia before each round and at the end). A cluster without
    rows keeps its centre. Ends early when inertia falls by no more than ``tolerance``."""
    base = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    centres, inertia = [list(map(float, c)) for c in centres], []
    for i in range(rounds + 1):
        own = base.withColumn("__n", nearest(features, centres))
        rows = own.groupBy("__n.cluster").agg(
            F.count("*").alias("n"), F.sum("__n.d2").alias("cost"), *[F.sum(f).alias(f"s{j}") for j, f in enumerate(features)]).collect()
        inertia.append(sum(r["cost"] for r in sorted(rows, key=lambda r: r["cluster"])))
        if i == rounds or (i and inertia[-2] - inertia[-1] <= tolerance):
            break
        for r in rows:
            centres[r["cluster"]] = [r[f"s{j}"] / r["n"] for j in range(len(features))]
    return centres, inertia


def kmeans_segments(df: DataFrame, features: Sequence[str], centres: Centres, key: str = "client_id") -> DataFrame:
    """``(key, cluster, distance)`` by the nearest centre."""
    out = df.select(key, *[F.col(f).cast("double").alias(f) for f in features]).withColumn("__n", nearest(features, centres))
    return out.select(key, F.col("__n.cluster").alias("cluster"), F.sqrt("__n.d2").alias("distance"))

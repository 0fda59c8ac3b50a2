"""Embedding near-duplicates with an inverted multi-index.

The halves of the unit vectors have a codebook each (k-means on a bounded
sample); the pair of nearest codes is a vector's cell in the product grid.
Every vector is indexed in its cell and, as a query, visits the nearest cells in
multi-sequence order (ascending sum of the two halves' distances). How many it
visits is calibrated for a target recall: sample vectors are turned by exactly
the threshold angle in random directions, and enough cells are visited that the
wanted share of these worst cases is found. Candidates are then verified by
their cosine in double precision.

Equal vectors are one class with a weight, so copies are never paired. A pair is
found if either vector visits the other's cell; each class counts its links
where it is the visitor, and where it is visited by one whose cell it does not
visit itself, so that every link counts once on both sides and no pair leaves
the task. A task sends counts per class and a spanning forest of its links.
Cells with many vectors are dealt out in blocks of residents and visitors, and
every block of a cell meets every other.

Vectors of several lengths. The length is part of the cell, so only vectors of
one length meet. The most frequent lengths, up to LENGTHS of them, share the
sample and have codebooks and a calibration each; all vectors of any other
length are in one cell and are compared in full, in blocks.

Bounds: the samples have at most ``sample`` vectors together, a codebook at most
``max_codes`` codes, so a grid at most max_codes^2 cells (the table that is
broadcast); the codes follow the number of vectors below that.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and vectors of different lengths not with each
other; a null id likewise (component null, kept). Rows that repeat an id are
separate rows. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, hot_join, num_partitions, sorted_groups
from .components import connected_components

RESIDENTS, VISITORS = 2048, 8192
#: Lengths with codebooks of their own, and the bits of a cell's number beside the length.
LENGTHS, CELL_BITS = 8, 32


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def visit_order(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cells: int) -> np.ndarray:
    """The first ``cells`` cells of the multi-sequence traversal for each row:
    the cell of the i-th and j-th nearest codes has (i+1)(j+1)-1 cells before
    it, so only the pairs with (i+1)(j+1) <= cells can be among them."""
    half = x.shape[1] // 2
    d = [distances(x[:, :half], books[0]), distances(x[:, half:], books[1])]
    order = [np.argsort(m, axis=1, kind="stable")[:, :cells] for m in d]
    near = [np.take_along_axis(m, o, axis=1) for m, o in zip(d, order, strict=True)]
    ij = np.array([(i, j) for i in range(order[0].shape[1]) for j in range(order[1].shape[1])
                   if (i + 1) * (j + 1) <= cells])
    total = near[0][:, ij[:, 0]] + near[1][:, ij[:, 1]]
    first = np.argsort(total, axis=1, kind="stable")[:, :cells]
    i, j = ij[first, 0], ij[first, 1]
    return np.take_along_axis(order[0], i, axis=1) * len(books[1]) + np.take_along_axis(order[1], j, axis=1)


def calibrate(x: np.ndarray, books, threshold: float, recall: float, seed: int = 11) -> int:
    """Cells to visit so that pairs exactly at the threshold are found with the wanted recall."""
    rng = np.random.default_rng(seed)
    x = x[rng.choice(len(x), min(len(x), 512), replace=False)]
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1)[:, None] * x
    norm = np.linalg.norm(side, axis=1)
    if not norm.all():
        return 1
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * side / norm[:, None]
    grid = len(books[0]) * len(books[1])
    cells = 1
    while True:
        vx, vy = visit_order(x, books, cells), visit_order(y, books, cells)
        found = (vy == vx[:, :1]).any(axis=1) | (vx == vy[:, :1]).any(axis=1)
        if found.mean() >= recall or cells >= grid:
            return min(cells, grid)
        cells = min(grid, max(cells + 1, cells * 5 // 4))


def _links(q: pd.DataFrame, r: pd.DataFrame, threshold: float):
    """Counts and a spanning forest for the visitors and residents of a block."""
    x = np.frombuffer(b"".join(q["vec"]), dtype="<f8").reshape(len(q), -1)
    y = np.frombuffer(b"".join(r["vec"]), dtype="<f8").reshape(len(r), -1)
    qn, rn = q["node"].to_numpy(), r["node"].to_numpy()
    qw, rw = q["size"].to_numpy().astype(float), r["size"].to_numpy().astype(float)
    qcell = q["own"].to_numpy()
    visits = np.stack([np.frombuffer(v, dtype="<i8") for v in r["visits"]])
    q_sum, r_sum = np.zeros(len(q)), np.zeros(len(r))
    label, q_first = np.arange(len(r)), np.full(len(q), -1)
    for a in range(0, len(q), 512):
        b = min(a + 512, len(q))
        hit = (x[a:b] @ y.T >= threshold) & (qn[a:b, None] != rn)
        rows = np.flatnonzero(hit.any(axis=1))
        if not len(rows):
            continue
        q_sum[a:b] += hit @ rw
        both = np.zeros_like(hit)
        for c in np.unique(qcell[a:b]):
            both[np.ix_(qcell[a:b] == c, (visits == c).any(axis=1))] = True
        r_sum += qw[a:b] @ (hit & ~both)
        for i in rows:
            to = np.flatnonzero(hit[i])
            q_first[a + i] = to[0]
            roots = np.unique(label[to])
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    at = np.flatnonzero(q_first >= 0)
    counts = pd.DataFrame({"kind": 0, "a": np.concatenate([qn[q_sum > 0], rn[r_sum > 0]]),
                           "b": np.concatenate([q_sum[q_sum > 0], r_sum[r_sum > 0]]).astype(np.int64)})
    joined = np.flatnonzero(label != np.arange(len(r)))
    edges = pd.DataFrame({"kind": 1, "a": np.concatenate([qn[at], rn[joined]]),
                          "b": np.concatenate([rn[label[q_first[at]]], rn[label[joined]]])})
    return pd.concat([counts, edges])


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    threshold: float = 0.95, recall: float = 0.99, sample: int = 16384,
                    max_codes: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    spark = vectors.sparkSession
    src = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vec_col).cast("array<double>").alias("v"))
    ok = (F.col("vec_id").isNotNull() & F.col("v").isNotNull()
          & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
          & F.exists("v", lambda x: x != 0))
    src = src.withColumn("ok", F.coalesce(ok, F.lit(False)))
    good = src.where("ok").select("vec_id", "v")
    classes = good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    # node numbers ascend with the smallest id of a class, so the smallest node of a component has its smallest id
    classes = cut_lineage(classes.orderBy("least").withColumn("node", F.monotonically_increasing_id()), "op9-classes")
    rows = classes.agg(F.sum("size"), F.count("*")).first()
    lonely = src.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                        F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not rows[1]:
        return lonely
    lengths = (classes.where("size(v) > 1").groupBy(F.size("v").alias("d")).count()
               .orderBy(F.desc("count"), "d").limit(LENGTHS).collect())
    plans = {}
    for d, n in lengths:
        picked = (classes.where(F.size("v") == d).orderBy(F.xxhash64("v"), "node").limit(max(sample // len(lengths), 2))
                  .select("v").toPandas()["v"])
        x = unit(np.stack(picked.to_list()))
        codes = int(min(max_codes, max(2, math.isqrt(n // 16)), len(x)))
        books = (k_means(x[:, :d // 2], codes), k_means(x[:, d // 2:], codes))
        plans[d] = (books, calibrate(x, books, threshold, recall))

    def place(batches):
        for pdf in batches:
            for d, own in pdf.groupby(pdf["v"].map(len)):
                u = unit(np.stack(own["v"].to_list()))
                if d in plans:
                    visits = np.concatenate([visit_order(u[i:i + 1024], *plans[d]) for i in range(0, len(u), 1024)])
                else:
                    visits = np.zeros((len(u), 1), dtype=np.int64)
                visits = visits + (d << CELL_BITS)
                yield pd.DataFrame({"node": own["node"].to_numpy(), "size": own["size"].to_numpy(), "own": visits[:, 0],
                                    "vec": [r.tobytes() for r in u],
                                    "visits": [r.astype("<i8").tobytes() for r in visits],
                                    "cells": list(visits)})

    placed = cut_lineage(classes.repartition("node").mapInPandas(
        place, "node long, size long, own long, vec binary, visits binary, cells array<long>"), "op9-placed")
    at = placed.groupBy(F.col("own").alias("cell")).agg(F.count("*").alias("residents"))
    came = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("visitors"))
    stats = at.join(came, "cell").select("cell", F.ceil(F.col("residents") / RESIDENTS).alias("r_blocks"),
                                         F.ceil(F.col("visitors") / VISITORS).alias("q_blocks"))
    stats = F.broadcast(cut_lineage(stats, "op9-cells"))
    block = lambda n: F.pmod(F.xxhash64("node"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    fields = ["cell", "r_block", "q_block", "role", "node", "size", "own", "vec", "visits"]
    homes = (placed.withColumn("cell", F.col("own")).join(stats, "cell")
             .withColumn("r_block", block(F.col("r_blocks"))).withColumn("q_block", every(F.col("q_blocks")))
             .withColumn("role", F.lit(0)).select(fields))
    guests = (placed.withColumn("cell", F.explode("cells")).join(stats, "cell")
              .withColumn("q_block", block(F.col("q_blocks"))).withColumn("r_block", every(F.col("r_blocks")))
              .withColumn("role", F.lit(1)).withColumn("visits", F.lit(None).cast("binary")).select(fields))

    def verify(batches):
        for _, g in sorted_groups(batches, ["cell", "r_block", "q_block"]):
            q, r = g[g["role"] == 1], g[g["role"] == 0]
            if len(q) and len(r):
                yield _links(q, r, threshold)

    keys = ["cell", "r_block", "q_block"]
    found = cut_lineage(homes.unionByName(guests).repartition(num_partitions(vectors), *keys)
                        .sortWithinPartitions(*keys).mapInPandas(verify, "kind int, a long, b long"), "op9-links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    comps = connected_components(found.where("kind = 1"))
    comps = cut_lineage(comps, "op9-components")
    named = classes.select(F.col("node").alias("component"), F.col("least").alias("component_id"))
    named = comps.groupBy("component").agg(F.count("*").alias("n")).join(named, "component")
    comps = hot_join(comps, named, "component", "n", rows[1]).select("node", "component_id")
    known = (classes.join(links, "node", "left").join(comps, "node", "left")
             .select("v", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                     F.coalesce("component_id", "least").alias("component_id")))
    out = hot_join(good, known, "v", "size", rows[0]).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(lonely)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that huge and tiny components neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]

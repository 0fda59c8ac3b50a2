"""Exact k nearest neighbours of the rows of a table among themselves.

Pivot cells with distance bounds: every vector belongs to the cell of its
nearest pivot. A first pass compares it with the vectors of its own block of
that cell; the (k+1)-th distance found there bounds how far its neighbours can
be. By the triangle inequality a cell whose distances to its pivot lie in [lo,
hi] holds nothing nearer than ``max(d - hi, lo - d)`` to a vector at distance d
from that pivot, nor nearer than the plane between the two pivots. A second
pass visits only the cells these bounds cannot rule out, so no step compares
all pairs, and the result is exact whatever the pivots.

* Equal vectors are one class; of its ids only the k+1 smallest can be anybody's
  neighbour, so copies are never compared with each other.
* A cell is dealt out in blocks of ``BLOCK`` vectors, its visitors in blocks of
  ``VISITORS``; a task holds one block of each.
* Pivots are about the square root of the vectors, ``max_pivots`` at most: the
  table of pivots and cell bounds that tasks carry has that bound.
* Distances are sums of squared differences from the first component to the
  last, in double precision, so ties and their order by id agree with the same
  sum in SQL.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import keyed_join
from ..session import cut_lineage

BLOCK, VISITORS = 2048, 16384
SLACK = 1e-9          # bounds give way by this share, more than rounding can take


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums from the first component on, as SQL would add them."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d = x[:, i, None] - y[None, :, i]
        out += d * d
    return out


def _nearest(d2: np.ndarray, ids: list, most: int, within: float = math.inf) -> list[tuple[float, int]]:
    """The ``most`` smallest (distance, id) among classes with sorted ids each."""
    at = np.flatnonzero(d2 <= within)
    if len(at) > most:
        at = at[d2[at] <= np.partition(d2[at], most - 1)[most - 1]]
    return sorted((float(d2[j]), int(i)) for j in at for i in ids[j])[:most]


def _groups(batches, keys: list[str]):
    """Runs of equal keys from batches sorted by them."""
    held, open_key = [], None
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[a])
            if held and key != open_key:
                yield pd.concat(held)
                held = []
            open_key = key
            held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held)


def nearest_neighbours(points: DataFrame, k: int, key: str = "client_id", vector: str = "x",
                       max_pivots: int = 512) -> DataFrame:
    """``(key, rank, neighbour, distance)``: the ``k`` nearest other rows of
    each row by (distance, id); ``key`` is a unique integer id, ``vector`` an
    array of doubles of one length. Rows with a null vector or component, or
    one that is not finite, have no neighbours and are nobody's. With fewer than ``k`` other
    rows there are fewer ranks."""
    schema = f"`{key}` long, rank int, neighbour long, distance double"
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = points.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x")).where(
        F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)))
    # -0.0 and 0.0 are one value, so that equal vectors are one class
    rows = cut_lineage(rows.withColumn("x", F.transform("x", lambda c: c + F.lit(0.0))), "knn-rows")
    first = Window.partitionBy("x").orderBy("id")
    classes = (rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
               .groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    sizes = rows.groupBy("x").agg(F.count("*").alias("size"))
    classes = cut_lineage(classes.join(sizes, "x").withColumn("node", F.monotonically_increasing_id()), "knn-classes")
    n = classes.count()
    if not n or k < 1:
        return spark.createDataFrame([], schema)
    picked = classes.orderBy(F.xxhash64("x"), "node").limit(min(max_pivots, max(1, math.isqrt(n)))).select("x").collect()
    pivots = np.array([r["x"] for r in picked], dtype=float)
    between = np.sqrt(squared_distances(pivots, pivots))

    def vectors(pdf):
        return np.stack(pdf["x"].to_list()).astype(float)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                d = np.sqrt(squared_distances(vectors(pdf), pivots))
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell, radius=d[np.arange(len(d)), cell])

    placed = cut_lineage(classes.mapInPandas(
        place, "x array<double>, ids array<long>, size long, node long, cell int, radius double"), "knn-placed")
    # a row per cell: max_pivots at most
    bounds = placed.groupBy("cell").agg(F.min("radius").alias("lo"), F.max("radius").alias("hi"),
                                        F.count("*").alias("n")).collect()
    lo, hi = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    blocks = {}
    for r in bounds:
        lo[r["cell"]], hi[r["cell"]] = r["lo"], r["hi"]
        blocks[r["cell"]] = -(-r["n"] // BLOCK)
    count = F.create_map(*[F.lit(v) for c, b in blocks.items() for v in (c, b)])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), count[F.col("cell")]).cast("int"))

    def visits(x: np.ndarray, cell: np.ndarray, bound: np.ndarray) -> list[list[int]]:
        d = np.sqrt(squared_distances(x, pivots))
        own = d[np.arange(len(d)), cell]
        gap = np.maximum(d - hi, lo - d)
        apart = between[cell]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d * d - (own * own)[:, None]) / (2 * apart)
        gap = np.maximum(gap, np.where(apart > 0, plane, -np.inf))
        scale = d + own[:, None] + bound[:, None]
        with np.errstate(invalid="ignore"):
            near = gap <= bound[:, None] + SLACK * scale
        near |= np.isinf(bound)[:, None]
        return [np.flatnonzero(row & (hi >= 0)).tolist() for row in near]

    def bound(batches):
        for g in _groups(batches, ["cell", "block"]):
            x, ids = vectors(g), g["ids"].to_list()
            weight = np.array([len(i) for i in ids])
            out = np.empty(len(g))
            for a in range(0, len(g), 256):
                d2 = squared_distances(x[a:a + 256], x)
                for i, row in enumerate(d2):
                    order = np.argsort(row, kind="stable")[:k + 1]
                    have = np.cumsum(weight[order])
                    out[a + i] = math.sqrt(row[order[np.searchsorted(have, k + 1)]]) if have[-1] > k else math.inf
            cells = visits(x, g["cell"].to_numpy(), out)
            yield g[["node", "x"]].assign(bound=out, cells=cells)

    by = ["cell", "block"]
    guests = cut_lineage(placed.select(*by, "node", "x", "ids").repartition(parts, *by).sortWithinPartitions(*by).mapInPandas(
        bound, "node long, x array<double>, bound double, cells array<int>"), "knn-bounds")
    came = {r["cell"]: r["n"] for r in guests.select(F.explode("cells").alias("cell")).groupBy("cell")
            .agg(F.count("*").alias("n")).collect()}
    shares = F.create_map(*[F.lit(v) for c in blocks for v in (c, -(-came.get(c, 1) // VISITORS))])
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    fields = ["cell", "block", "share", "role", "node", "x", "ids", "bound"]
    homes = placed.withColumns({"share": every(shares[F.col("cell")]), "role": F.lit(0),
                                "bound": F.lit(None).cast("double")}).select(fields)
    calls = (guests.withColumn("cell", F.explode("cells")).withColumn("block", every(count[F.col("cell")]))
             .withColumns({"share": F.pmod(F.xxhash64("node"), shares[F.col("cell")]).cast("int"), "role": F.lit(1),
                           "ids": F.lit(None).cast("array<long>")}).select(fields))

    def search(batches):
        for g in _groups(batches, ["cell", "block", "share"]):
            home, calling = g[g["role"] == 0], g[g["role"] == 1]
            if not len(home) or not len(calling):
                continue
            y, ids = vectors(home), home["ids"].to_list()
            for a in range(0, len(calling), 256):
                part = calling.iloc[a:a + 256]
                found = [(node, d, i) for node, row, b in
                         zip(part["node"], squared_distances(vectors(part), y), part["bound"], strict=True)
                         for d, i in _nearest(row, ids, k + 1, b * b * (1 + SLACK))]
                yield pd.DataFrame(found, columns=["node", "d2", "id"])

    keys = ["cell", "block", "share"]
    found = homes.unionByName(calls).repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(
        search, "node long, d2 double, id long")
    best = Window.partitionBy("node").orderBy("d2", "id")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    near = found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("d2", "id"))).alias("near"))
    near = classes.join(near, "node").select("x", "size", "near")
    out = keyed_join(rows, near, "x", "size", rows.count())
    others = F.slice(F.filter("near", lambda s: s["id"] != F.col("id")), 1, k)
    out = out.select("id", F.posexplode(others).alias("at", "s"))
    return out.select(F.col("id").alias(key), (F.col("at") + 1).alias("rank"), F.col("s.id").alias("neighbour"),
                      F.sqrt("s.d2").alias("distance"))

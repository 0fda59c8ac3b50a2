"""Embedding whitening from a covariance over distinct vectors.

Method: weighted multiplicity covariance. Entries become integers (``x =
floor(scale * c) + shift``), equal x vectors are one row of a table with their
count, the fit weighs each by its count or by one (``weights``), the centred
product ``sum w (x - mean)(x - mean)^T`` is a matrix product per task, each
distinct vector is whitened once, and the rows of the input are joined back by
their x vector.

Exactness: sums of the integers are exact (128-bit decimals). Vectors are centred as
``(n x - S) / n`` with n and S exact, so an offset that is large against the
spread costs no digit, and only then multiplied. Components are eigenvectors of
the covariance by falling eigenvalue.

Plan. Equal vectors are counted with a map-side combine. Tasks return one
partial matrix; these are summed in a second layer of fewer tasks (the square
root of the shuffle partitions), so the driver gets few matrices of dimension squared (their
total size is checked against ``max_model_bytes``). A vector that holds a large
part of all rows is joined back by a broadcast of bounded number (``hot_join``).

Edge cases: rows whose vector is null, empty or holds null or non-finite entries
are dropped. Vectors of each length are fitted by themselves. Entries are held
within +-2^52 (as integers). A component whose variance is nil or lost in
rounding (one distinct vector, constant or dependent columns) has a null in
place of a whitened value; ``explained`` is null where no column varies. Ids may
repeat or be null. A deviation beyond a long is null. An empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, hot_join, num_partitions

LIMIT = float(1 << 52)
LONG = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float, shift: int) -> DataFrame:
    """(vec_id, x): rows with a whole, finite vector."""
    src = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.greatest(F.least(F.lit(float(scale)) * c, F.lit(LIMIT)), F.lit(-LIMIT))
    return src.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite).select(
        "vec_id", F.transform("v", lambda c: F.floor(held(c)) + F.lit(shift)).alias("x"))


def _matrices(pdf: pd.DataFrame, column: str, dtype: str):
    """(length, positions, matrix) for the vectors of each length in a batch."""
    lengths = pdf[column].map(len).to_numpy()
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, np.stack(pdf[column].iloc[at].to_list()).astype(dtype)


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """``(n x - S) / n``, where n x - S is exact."""
    return _deviations(x, n, s).astype(np.float64) / n


def _deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    if n * (int(np.abs(x).max()) + 1) < LONG // 4 and max(map(abs, s)) < LONG // 4:
        return n * x - np.array(s, dtype=np.int64)
    return n * x.astype(object) - np.array(s, dtype=object)


def _squares(dev: np.ndarray) -> list[int | None]:
    """Exact sums of squares per row; None beyond a long."""
    if dev.dtype != object and float(np.abs(dev).max()) ** 2 * dev.shape[1] < LONG // 4:
        return [int(v) for v in (dev * dev).sum(axis=1)]
    sums = [sum(int(v) ** 2 for v in row) for row in dev]
    return [v if v <= LONG else None for v in sums]


def _summed(df: DataFrame, partial, schema: str, combine) -> list:
    """Partials of each task, combined in a second, smaller layer of tasks and then returned."""
    first = df.mapInPandas(partial, schema)
    fan = max(1, math.isqrt(num_partitions(df)))
    return first.repartition(fan).mapInPandas(combine, schema).collect()


_GRAM = "d int, gram binary"


def _add_grams(batches):
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for d, g in zip(pdf["d"], pdf["gram"], strict=True):
            m = np.frombuffer(g, dtype="<f8")
            total[d] = total[d] + m if d in total else m
    if total:
        yield pd.DataFrame({"d": list(total), "gram": [m.tobytes() for m in total.values()]})


def _gram(df: DataFrame, partial) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for r in _summed(df, partial, _GRAM, _add_grams):
        m = np.frombuffer(bytes(r["gram"]), dtype="<f8")
        out[r["d"]] = out[r["d"]] + m if r["d"] in out else m
    return {d: m.reshape(math.isqrt(len(m)), -1) for d, m in out.items()}


def fit(distinct: DataFrame, weights: str, components: int, max_model_bytes: int) -> dict[int, dict]:
    """Per vector length: n, exact sums, whitening matrix, eigenvalue shares."""
    weigh = weights == "count"

    def sums(batches):
        total: dict[int, list] = {}
        for pdf in batches:
            w = pdf["copies"].to_numpy().astype(np.int64) if weigh else np.ones(len(pdf), dtype=np.int64)
            for d, at, x in _matrices(pdf, "x", "int64"):
                high, low = x >> 26, x & ((1 << 26) - 1)     # neither sum can overflow
                acc = total.setdefault(d, [0] * (d + 1))
                acc[0] += int(w[at].sum())
                wo = w[at].astype(object) if weigh else None
                for j in range(d):
                    h = (high[:, j] * wo).sum() if weigh else high[:, j].sum()
                    lo = (low[:, j] * wo).sum() if weigh else low[:, j].sum()
                    acc[j + 1] += (int(h) << 26) + int(lo)
        if total:
            yield pd.DataFrame({"d": list(total), "sums": [[Decimal(v) for v in a] for a in total.values()]})

    def add(batches):
        total: dict[int, list] = {}
        for pdf in batches:
            for d, s in zip(pdf["d"], pdf["sums"], strict=True):
                total[d] = [a + int(b) for a, b in zip(total.get(d, [0] * (d + 1)), s, strict=True)]
        if total:
            yield pd.DataFrame({"d": list(total), "sums": [[Decimal(v) for v in a] for a in total.values()]})

    lengths = [r["d"] for r in distinct.select(F.size("x").alias("d")).distinct().collect()]
    if 8 * sum(d * d for d in lengths) > max_model_bytes:
        raise ValueError(f"covariances of {len(lengths)} vector lengths need more than {max_model_bytes} bytes")
    total: dict[int, list[int]] = {}
    for r in _summed(distinct, sums, "d int, sums array<decimal(38,0)>", add):
        total[r["d"]] = [a + int(b) for a, b in zip(total.get(r["d"], [0] * (r["d"] + 1)), r["sums"], strict=True)]

    def products(batches):
        grams: dict[int, np.ndarray] = {}
        for pdf in batches:
            w = pdf["copies"].to_numpy().astype(np.float64)
            for d, at, x in _matrices(pdf, "x", "int64"):
                c = centred(x, total[d][0], total[d][1:])
                g = c.T @ (c * w[at, None] if weigh else c)
                grams[d] = grams[d] + g if d in grams else g
        if grams:
            yield pd.DataFrame({"d": list(grams), "gram": [g.tobytes() for g in grams.values()]})

    models = {}
    for d, g in _gram(distinct, products).items():
        n = total[d][0]
        v = (g + g.T) / (2.0 * n)
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        k = min(components, d)
        solid = e[:k] > d * np.finfo(float).eps * max(float(e[0]), 0.0)
        trace = float(np.trace(v))
        scale = np.where(solid, 1.0 / np.sqrt(np.where(solid, e[:k], 1.0)), np.nan)
        models[d] = {"n": n, "sums": total[d][1:], "matrix": u[:, :k] * scale,
                     "explained": [max(float(a), 0.0) / trace if trace > 0 else None for a in e[:k]]}
    return models


def identity_errors(white: DataFrame, models: dict[int, dict], weights: str) -> dict[int, float | None]:
    """Per length the largest entry of the whitened vectors' covariance minus the identity."""
    weigh = weights == "count"
    w = F.col("copies") if weigh else F.lit(1)
    k_max = max(len(m["explained"]) for m in models.values())
    means = {r["d"]: [r[f"m{i}"] for i in range(k_max)] for r in white.groupBy("d").agg(
        *[(F.sum(F.get("white", F.lit(i)) * w) / F.sum(w)).alias(f"m{i}") for i in range(k_max)]).collect()}
    means = {d: np.array([np.nan if v is None else v for v in m]) for d, m in means.items()}

    def products(batches):
        grams: dict[int, np.ndarray] = {}
        for pdf in batches:
            ws = pdf["copies"].to_numpy().astype(np.float64)
            for d in pdf["d"].unique():
                at = np.flatnonzero(pdf["d"] == d)
                y = np.stack(pdf["white"].iloc[at].to_list()).astype(np.float64)
                y = y - means[d][:y.shape[1]]
                g = y.T @ (y * ws[at, None] if weigh else y)
                grams[d] = grams[d] + g if d in grams else g
        if grams:
            yield pd.DataFrame({"d": list(grams), "gram": [g.tobytes() for g in grams.values()]})

    out = {}
    for d, g in _gram(white.select("d", "copies", "white"), products).items():
        solid = ~np.isnan(np.diag(g))
        g = g[np.ix_(solid, solid)] / models[d]["n"]
        out[d] = float(np.abs(g - np.eye(len(g))).max()) if len(g) else None
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64,
           shift: int = 1_000_000, components: int = 16, weights: str = "one",
           max_model_bytes: int = 64 << 20) -> DataFrame:
    """vec_id, n, deviation, white (whitened components), explained (shares of the
    trace), identity_error: one row per row with a usable vector."""
    if weights not in ("one", "count"):
        raise ValueError("weights is one or count")
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vec_col, scale, shift)
    schema = "vec_id long, n long, deviation long, white array<double>, explained array<double>, identity_error double"
    distinct = cut_lineage(rows.groupBy("x").agg(F.count("*").alias("copies")), "op13-distinct")
    models = fit(distinct, weights, components, max_model_bytes)
    if not models:
        return spark.createDataFrame([], schema)

    def apply(batches):
        for pdf in batches:
            for d, at, x in _matrices(pdf, "x", "int64"):
                m = models[d]
                dev = _deviations(x, m["n"], m["sums"])
                white = (dev.astype(np.float64) / m["n"]) @ m["matrix"]
                yield pd.DataFrame({"x": pdf["x"].iloc[at].to_list(), "copies": pdf["copies"].iloc[at].to_numpy(), "d": d,
                                    "deviation": pd.array(_squares(dev), dtype="Int64"), "white": list(white)})

    white = cut_lineage(distinct.mapInPandas(
        apply, "x array<long>, copies long, d int, deviation long, white array<double>"), "op13-white")
    errors = identity_errors(white, models, weights)
    known = spark.createDataFrame([(d, m["n"], m["explained"], errors[d]) for d, m in models.items()],
                                  "d int, n long, explained array<double>, identity_error double")
    known = white.join(F.broadcast(known), "d")     # a row per length, size checked in fit
    total = white.agg(F.sum("copies")).first()[0]
    nan_null = F.transform("white", lambda v: F.when(~F.isnan(v), v))
    return hot_join(rows, known, "x", "copies", total).select(
        "vec_id", "n", "deviation", nan_null.alias("white"), "explained", "identity_error")


def whitened_components(vectors: DataFrame, **options) -> DataFrame:
    """One row per row of :func:`whiten` and component, numbered from 1."""
    out = whiten(vectors, **options)
    return out.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.col("explained")[F.col("at")].alias("explained"), "identity_error")

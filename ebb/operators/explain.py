"""Per-client feature attribution.

Attributions are a long DataFrame ``(key, feature, contribution)``.

* Linear models (X1, exact): ``w_f * (x_f - mean_f)`` in the margin space;
  the base value is the margin at the feature means.
* Tree ensembles (X1, exact): :mod:`.tree_explain`.
* Any model (X1, sampled): permutation Shapley values against one reference
  point (the feature means). For each row and seeded permutation, the F+1
  coalition vectors between the reference and the row are exploded, scored by
  one ``transform`` of the model, and the differences of consecutive scores are
  credited to the feature that entered; the mean over permutations is the
  contribution. Contributions add up exactly to ``f(x) - f(reference)``. The
  permutation order comes from ``xxhash64(key, permutation, feature)``, so the
  result does not depend on partitioning. The work is ``rows x permutations x
  (features + 1)`` model evaluations, spread over the cluster.

The reference's kernel sampler explains the first 500 rows with an unseeded
draw; here every row is explained, deterministically (see README).
"""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as FX
from ..functions.exprs import fixed_decimals, sigmoid
from ..session import cut_lineage

log = logging.getLogger(__name__)

EVALS_PER_PARTITION = 2_000_000


def _long(X: DataFrame, key: str, features: Sequence[str], value) -> DataFrame:
    return X.select(key, F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(f).alias("feature"), value(f, i).alias("contribution"))
        for i, f in enumerate(features)])).alias("kv")).select(key, "kv.*")


def feature_means(X: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = X.agg(*[F.avg(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0))).alias(f"m{i}")
                  for i, f in enumerate(features)]).first()
    return {f: (row[f"m{i}"] or 0.0) for i, f in enumerate(features)}


def linear_contributions(X: DataFrame, coefficients: dict[str, float], intercept: float = 0.0,
                         key: str = "client_id", means: dict[str, float] | None = None
                         ) -> tuple[DataFrame, float]:
    """Exact attributions of a linear margin; returns (long frame, base margin)."""
    feats = list(coefficients)
    means = means if means is not None else feature_means(X, feats)
    val = lambda f, i: F.lit(float(coefficients[f])) * (
        F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) - F.lit(float(means[f])))
    base = float(intercept) + sum(float(coefficients[f]) * means[f] for f in feats)
    return _long(X, key, feats, val), base


def permutation_contributions(score_fn, X: DataFrame, features: Sequence[str], key: str = "client_id",
                              permutations: int = 8, seed: int = 42,
                              reference: dict[str, float] | None = None) -> tuple[DataFrame, float]:
    """Sampled Shapley values of ``score_fn`` (a function DataFrame -> DataFrame
    that reads ``features`` (vector) and adds a double column ``score``)."""
    features = list(features)
    nf = len(features)
    ref = reference if reference is not None else feature_means(X, features)
    x = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])
    r = F.array(*[F.lit(float(ref[f])) for f in features])
    idx = F.sequence(F.lit(0), F.lit(nf - 1))
    base_rows = X.select(key, x.alias("x"))
    # Spread the rows before they expand to permutations and F+1 steps and are
    # scored: an explicit partition count (not coalesced by AQE) sized by the
    # number of model evaluations. By key alone, so that the window per (key, p)
    # and the mean per (key, ordinal) below both reuse this partitioning.
    rows = X.count()
    work = rows * permutations * (nf + 1)
    parts = max(X.sparkSession.sparkContext.defaultParallelism, math.ceil(work / EVALS_PER_PARTITION))
    perms = base_rows.repartition(parts, key).select(
        key, "x", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("p"))
    # order[j] = feature entering at step j+1; pos[i] = step at which feature i enters
    order = F.transform(F.array_sort(F.transform(
        idx, lambda i: F.struct(F.xxhash64(F.col(key), F.col("p"), i, F.lit(seed)).alias("h"), i.alias("i")))),
        lambda s: s["i"])
    perms = perms.withColumn("order", order)
    perms = perms.withColumn("pos", F.transform(idx, lambda i: F.array_position("order", i) - 1))
    steps = perms.select(key, "p", "x", "order", "pos", F.explode(F.sequence(F.lit(0), F.lit(nf))).alias("s"))
    steps = steps.withColumn("features", array_to_vector(F.transform(
        idx, lambda i: F.when(F.col("pos")[i] < F.col("s"), F.col("x")[i]).otherwise(r[i]))))
    # what the window sorts holds the feature that entered, not the arrays
    scored = score_fn(steps).select(key, "p", "s", "score", F.get("order", F.col("s") - 1).alias("ordinal"))
    w = Window.partitionBy(key, "p").orderBy("s")
    diffs = (scored.withColumn("d", F.col("score") - F.lag("score").over(w))
             .where(F.col("s") > 0).select(key, "ordinal", "d"))
    names = F.array(*[F.lit(f) for f in features])
    contrib = (diffs.groupBy(key, "ordinal").agg(F.avg("d").alias("contribution"))
               .select(key, "ordinal", F.element_at(names, F.col("ordinal") + 1).alias("feature"),
                       "contribution"))
    spark = X.sparkSession
    ref_df = spark.createDataFrame([([float(ref[f]) for f in features],)], "r array<double>")
    base = score_fn(ref_df.select(array_to_vector("r").alias("features"))).first()["score"]
    return contrib, float(base)


def score_space(kind: str) -> str:
    """The scale of :func:`model_score_fn`'s scores."""
    return "margin" if kind == "lr" else "probability"


def model_score_fn(model, kind: str):
    """``score_fn`` for a fitted Spark ML classifier: P(churn), or the margin for
    LR; ``score_space(kind)`` names which, for :func:`explain_clients`."""
    def fn(df: DataFrame) -> DataFrame:
        m = model.copy()
        m.setPredictionCol("_pred").setProbabilityCol("_prob").setRawPredictionCol("_raw")
        out = m.transform(df)
        s = vector_to_array("_raw")[1] if kind == "lr" else vector_to_array("_prob")[1]
        return out.withColumn("score", s).drop("_pred", "_prob", "_raw")
    return fn


def global_importance(contribs: DataFrame, top: int = 15) -> DataFrame:
    """Mean absolute contribution per feature, 6 decimals, top ``top``."""
    g = contribs.groupBy("feature", "ordinal").agg(F.bround(F.avg(F.abs("contribution")), 6).alias("importance"))
    return g.orderBy(F.col("importance").desc(), "ordinal").limit(top).select("feature", "importance")


def importance_share(importance: DataFrame) -> DataFrame:
    """Importance (4 decimals) and share of the total in % (1 decimal);
    a zero total divides by 1. The input is at most ``top`` rows."""
    total = F.sum("importance").over(Window.partitionBy())
    tot = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return importance.select("feature", F.bround("importance", 4).alias("importance"),
                             F.bround(F.col("importance") / tot * 100, 1).alias("pct"))


def fallback_importance(importances: list[tuple[str, float]], top: int = 15) -> tuple[list, float]:
    """(top importances, base value 0.5) when no attribution can be made."""
    ranked = sorted(((f, round(float(v), 6)) for f, v in importances), key=lambda kv: kv[1], reverse=True)
    return ranked[:top], FX.FALLBACK_BASE_VALUE


@dataclass
class Explanation:
    method: str                 # "linear", "tree" or "importances"
    contributions: DataFrame
    base_value: float
    space: str                  # "margin" or "probability", for explain_clients
    importance: DataFrame       # (feature, importance), at most 15 rows


def explain_model(model, kind: str, X: DataFrame, features: Sequence[str],
                  importances: list[tuple[str, float]], key: str = "client_id") -> Explanation:
    """Exact attributions of a fitted model, or, for a model that is neither
    linear nor a tree ensemble, its own importances with contributions of 0 and the
    fixed base value. An attribution that fails raises."""
    from .tree_explain import is_ensemble, tree_contributions
    if kind == "lr" and hasattr(model, "coefficients"):
        coefficients = {f: float(w) for f, w in zip(features, model.coefficients, strict=True)}
        contribs, base = linear_contributions(X, coefficients, float(model.intercept), key)
        method, space = "linear", "margin"
    elif is_ensemble(model):
        contribs, base = tree_contributions(model, X, features, key)
        method, space = "tree", "margin" if kind == "gbt" else "probability"
    else:
        log.warning("no attribution for %s, using its importances", type(model).__name__)
        ranked, base = fallback_importance(importances)
        contribs = _long(X, key, features, lambda f, i: F.lit(0.0))
        frame = X.sparkSession.createDataFrame(ranked, "feature string, importance double")
        return Explanation("importances", contribs, base, "probability", frame)
    contribs = cut_lineage(contribs, "attributions")
    return Explanation(method, contribs, base, space, global_importance(contribs))


def client_factors(contribs: DataFrame, key: str = "client_id", top: int = 5) -> DataFrame:
    """X4, long form: the ``top`` factors per client by absolute contribution
    (ties in feature order), with direction and |contribution| (4 decimals)."""
    w = Window.partitionBy(key).orderBy(F.abs("contribution").desc(), "ordinal")
    r = contribs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return r.select(key, "rank", "feature",
                    F.bround(F.abs("contribution"), 4).alias("contribution"),
                    F.when(F.col("contribution") > 0, F.lit(FX.DIRECTION_RISK))
                     .otherwise(F.lit(FX.DIRECTION_PROTECTIVE)).alias("direction"))


def explain_clients(contribs: DataFrame, base_value: float, key: str = "client_id", top: int = 5,
                    space: str = "margin") -> DataFrame:
    """X4 for every client: top risk / protective factors, total effect,
    predicted probability and summary text. ``space="margin"`` applies the
    logistic link to ``base + total``; ``"probability"`` uses it as is."""
    f = client_factors(contribs, key, top)
    risk = F.col("direction") == FX.DIRECTION_RISK
    item = F.struct("rank", "feature", "contribution")
    per = f.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(risk, item))).alias("risk"),
        F.array_sort(F.collect_list(F.when(~risk, item))).alias("protective"))
    tot = contribs.groupBy(key).agg(F.sum("contribution").alias("total_effect"))
    j = tot.join(per, key, "left")
    z = F.lit(float(base_value)) + F.col("total_effect")
    prob = sigmoid(z) if space == "margin" else z
    j = j.withColumn("predicted_probability", prob)
    pct = F.concat(fixed_decimals(F.col("predicted_probability") * 100, 1), F.lit("%"))
    first = F.col("risk")[0]
    a, rest = FX.MSG_TOP_RISK.split("{feature}")
    b, rest = rest.split("{value3}")
    c, d = rest.split("{pct1}")
    with_risk = F.concat(F.lit(a), first["feature"], F.lit(b), fixed_decimals(first["contribution"], 3),
                         F.lit(c), pct, F.lit(d))
    e, g = FX.MSG_NO_RISK.split("{pct1}")
    summary = F.when(F.size("risk") > 0, with_risk).otherwise(F.concat(F.lit(e), pct, F.lit(g)))
    return j.select(key,
                    F.transform("risk", lambda s: s["feature"]).alias("top_risk_factors"),
                    F.transform("protective", lambda s: s["feature"]).alias("top_protective_factors"),
                    "total_effect", F.lit(float(base_value)).alias("base_value"),
                    "predicted_probability", summary.alias("summary"))


def top_risk_factor_names(contribs: DataFrame, key: str = "client_id", top: int = 5) -> DataFrame:
    """``(key, rank, feature)`` of the risk factors among the top ``top`` (A8 input)."""
    f = client_factors(contribs, key, top)
    return f.where(F.col("direction") == FX.DIRECTION_RISK).select(key, "rank", "feature")

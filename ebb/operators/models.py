"""Churn classifiers: train, cross-validate, calibrate, compare.

Three Spark ML estimators stand in for the reference's models:

* ``Logistic Regression``: ``LogisticRegression`` with L2 ``regParam = 1/n``
  and no internal standardisation, which is the same objective as C=1 with
  balanced sample weights (the weights sum to ``n``);
* ``Random Forest``: ``RandomForestClassifier(numTrees=200, maxDepth=10,
  minInstancesPerNode=20)`` with balanced weights;
* ``XGBoost`` (the slot name of the reference): Spark's ``GBTClassifier`` with
  200 rounds, depth 6, step 0.05, 80 % row and feature sampling, and
  ``neg/pos`` weight on positives in place of ``scale_pos_weight``.

Folds are stratified: clients of one label in the order of ``md5(key|seed)`` take
the folds in turn. Their ranks are running totals over ranges
(:func:`prefix_sums`), so no window holds a whole label, and the folds do not
depend on the partitioning. Every fold fit weighs and regularises by the rows
it is fitted on. Fold fits run concurrently from a thread pool, as
``CrossValidator(parallelism=...)`` does; the metrics of all models and folds
come from one grouped pass.
Calibration is Platt's sigmoid (with his target smoothing) fitted by a
one-feature weighted ``LogisticRegression`` on out-of-fold scores; the
calibrated probability is the mean of the fold calibrators, as in a k-fold
calibrated ensemble. When CV and calibration use the same number of folds, the
fold models serve both. The training frame is checkpointed to the shared
checkpoint folder, so a lost executor does not recompute the feature job. A fit
runs when a result of the report first needs it.

With ``use_smote=True`` each fit is preceded by SMOTE (T5, :mod:`.smote`) on its own
rows: the new rows of a fold come from the rows it is fitted on, never from
held-out ones. Calibration and metrics use the given rows only.
"""

from __future__ import annotations

import math
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as FX
from ..functions.cumulative import prefix_sums
from ..functions.exprs import col, sigmoid
from ..session import cut_lineage
from . import metrics as M
from .smote import oversample

SEED = 42
#: Partitions of the training frame at least, and rows per partition beyond that: they
#: follow the number of clients alone, so the same clients give the same model on any cluster.
#: Each partition sends a histogram of every tree node to the shuffle, so more of them cost
#: more than they spread, as several fits run at once.
FIT_PARTITIONS, FIT_ROWS = 4, 250_000
#: Rows per task of passes over scores and features.
PASS_ROWS = 50_000


@dataclass
class ModelSpec:
    name: str
    kind: str          # "lr", "rf", "gbt"
    params: dict = field(default_factory=dict)

    def estimator(self, n: int, suffix: str):
        cols = dict(featuresCol="features", labelCol="label", predictionCol=f"pred{suffix}",
                    rawPredictionCol=f"raw{suffix}", probabilityCol=f"prob{suffix}")
        if self.kind == "lr":
            # tol 1e-4 and maxIter 2000 are the reference solver's settings
            p = dict(maxIter=2000, tol=1e-4, regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                     standardization=False, weightCol="w_bal") | self.params
            return LogisticRegression(**cols, **p)
        if self.kind == "rf":
            # kept node numbers save walking every tree from its root at each level; the
            # splits are the same, and a depth of 10 needs no checkpoint on the way
            p = dict(numTrees=200, maxDepth=10, minInstancesPerNode=20, seed=SEED, weightCol="w_bal",
                     cacheNodeIds=True, checkpointInterval=-1) | self.params
            return RandomForestClassifier(**cols, **p)
        p = dict(maxIter=200, maxDepth=6, stepSize=0.05, subsamplingRate=0.8,
                 featureSubsetStrategy="0.8", seed=SEED, weightCol="w_pos") | self.params
        prob, raw = cols.pop("probabilityCol"), cols.pop("rawPredictionCol")
        return GBTClassifier(**cols, **p).setProbabilityCol(prob).setRawPredictionCol(raw)

    def score_expr(self, suffix: str) -> Column:
        """The score the calibrator sees: the margin for LR (its decision
        function), P(churn) for the tree ensembles."""
        if self.kind == "lr":
            return vector_to_array(F.col(f"raw{suffix}"))[1]
        return vector_to_array(F.col(f"prob{suffix}"))[1]


def default_specs(overrides: dict | None = None) -> list[ModelSpec]:
    overrides = overrides or {}
    kinds = {"Logistic Regression": "lr", "Random Forest": "rf", "XGBoost": "gbt"}
    return [ModelSpec(n, kinds[n], overrides.get(n, {})) for n in FX.MODEL_NAMES]


def with_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds the vector ``features``. It is assembled from columns of safe names:
    a feature may be named after a category that holds a dot."""
    safe = {f"__f{i}": col(n).cast("double") for i, n in enumerate(names)}
    return VectorAssembler(inputCols=list(safe), outputCol="features").transform(df.withColumns(safe)).drop(*safe)


def with_weights(df: DataFrame, label: str = "label", counts: dict | None = None) -> DataFrame:
    """T4: balanced weights ``n / (2 n_class)`` and ``neg/pos`` on positives;
    ``counts`` holds the rows per class where they are known."""
    if counts is None:
        counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    pos, neg = counts.get(1.0, counts.get(1, 0)), counts.get(0.0, counts.get(0, 0))
    if pos == 0 or neg == 0:
        raise ValueError("training data needs both classes")
    y = F.col(label) == 1
    return df.withColumns({
        "w_bal": F.when(y, F.lit(n / (2.0 * pos))).otherwise(F.lit(n / (2.0 * neg))),
        "w_pos": F.when(y, F.lit(neg / pos)).otherwise(F.lit(1.0)),
    })


def with_folds(df: DataFrame, key: str, label: str, k: int, seed: int = SEED,
               out: str = "fold") -> DataFrame:
    """A stratified fold 0..k-1 per row; ``df`` is read more than once."""
    order = F.struct(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))).alias("h"),
                     F.col(key).alias("k"))
    ranked = prefix_sums(df.withColumns({"__order": order, "__one": F.lit(1)}), [label], "__order", ["__one"])
    return ranked.withColumn(out, F.pmod(F.col("cum___one") - 1, F.lit(k)).cast("int")) \
        .drop("__order", "__one", "cum___one")


def platt(scores: DataFrame, score: str = "s", label: str = "label", counts: dict | None = None
          ) -> tuple[float, float]:
    """Platt's sigmoid ``1/(1+exp(-(a*s+b)))`` with smoothed targets
    ``(N+ + 1)/(N+ + 2)`` and ``1/(N- + 2)``, as a weighted one-feature LR;
    ``counts`` holds the rows per class where they are known. The fit's passes
    read PASS_ROWS rows per task, and each row twice."""
    if counts is None:
        counts = {r[0]: r[1] for r in scores.groupBy(label).count().collect()}
    npos, nneg = counts.get(1.0, 0), counts.get(0.0, 0)
    t_pos, t_neg = (npos + 1.0) / (npos + 2.0), 1.0 / (nneg + 2.0)
    t = F.when(F.col(label) == 1, F.lit(t_pos)).otherwise(F.lit(t_neg))
    va = VectorAssembler(inputCols=[score], outputCol="sf")
    scores = scores.select(F.col(score).cast("double").alias(score), label)
    base = va.transform(scores.coalesce(max(1, -(-(npos + nneg) // PASS_ROWS))))
    twice = (base.select("sf", F.lit(1.0).alias("y"), t.alias("w"))
             .unionByName(base.select("sf", F.lit(0.0).alias("y"), (F.lit(1.0) - t).alias("w"))))
    m = LogisticRegression(featuresCol="sf", labelCol="y", weightCol="w", regParam=0.0,
                           standardization=False, maxIter=200).fit(twice)
    return float(m.coefficients[0]), float(m.intercept)


def held_out_probability(coefs: Sequence[tuple[float, float]]) -> Column:
    """Mean over the sigmoids of all folds but the row's own, of the score of
    the model that was fitted without the row's fold."""
    out = F.lit(None).cast("double")
    for i in range(len(coefs)):
        others = [sigmoid(F.lit(a) * F.col("score") + F.lit(b)) for j, (a, b) in enumerate(coefs) if j != i]
        out = F.when(F.col("fold") == i, sum(others[1:], others[0]) / len(others)).otherwise(out)
    return out


@dataclass
class CalibratedModel:
    spec: ModelSpec
    members: list          # fitted fold models
    platt: list            # (a, b) per member
    feature_names: list

    def transform(self, df: DataFrame, out: str = "churn_prob", keep: Sequence[str] = ()) -> DataFrame:
        """Mean of the calibrated fold models' probabilities (one plan, no join)."""
        cur = df if "features" in df.columns else with_features(df, self.feature_names)
        probs = []
        for i, (m, (a, b)) in enumerate(zip(self.members, self.platt)):
            sfx = f"_c{i}"
            m = m.copy()
            m.setPredictionCol(f"pred{sfx}").setProbabilityCol(f"prob{sfx}").setRawPredictionCol(f"raw{sfx}")
            cur = m.transform(cur)
            s = self.spec.score_expr(sfx)
            probs.append(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * s + F.lit(b)))))
        p = probs[0]
        for q in probs[1:]:
            p = p + q
        return cur.select(*keep, (p / len(probs)).alias(out))

    def write(self, path: str) -> None:
        """Each member through Spark ML persistence, plus the calibrators."""
        import json
        for i, m in enumerate(self.members):
            m.write().overwrite().save(f"{path}/member_{i}")
        meta = {"name": self.spec.name, "kind": self.spec.kind, "params": self.spec.params,
                "platt": self.platt, "feature_names": self.feature_names, "n": len(self.members)}
        from pyspark.sql import SparkSession
        SparkSession.getActiveSession().createDataFrame([(json.dumps(meta),)], "meta string") \
            .coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(path: str) -> "CalibratedModel":
        import json
        from pyspark.ml.classification import (GBTClassificationModel, LogisticRegressionModel,
                                               RandomForestClassificationModel)
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        cls = {"lr": LogisticRegressionModel, "rf": RandomForestClassificationModel,
               "gbt": GBTClassificationModel}[meta["kind"]]
        members = [cls.load(f"{path}/member_{i}") for i in range(meta["n"])]
        return CalibratedModel(ModelSpec(meta["name"], meta["kind"], meta["params"]), members,
                               [tuple(x) for x in meta["platt"]], meta["feature_names"])


def importances(spec: ModelSpec, model, names: list[str], top: int = 15) -> list[tuple[str, float]]:
    """Tree importances, or |coefficients| for LR; top 15."""
    if spec.kind == "lr":
        vals = [abs(float(v)) for v in model.coefficients]
    else:
        vals = [float(v) for v in model.featureImportances.toArray()]
    pairs = sorted(zip(names, vals), key=lambda kv: kv[1], reverse=True)
    return pairs[:top]


#: Columns of the metrics that need no CV.
EVALUATION = ("model string, fitted string, auc_roc double, precision double, recall double, f1 double, "
              "accuracy double")


class BaseModels(Mapping):
    """name -> model fitted on all rows, at the first use of the name."""

    def __init__(self, report: TrainingReport):
        self._report = report

    def __getitem__(self, name: str):
        return self._report.fits([(name, "full", None)])[name, "full", None]

    def __iter__(self):
        return iter(self._report.specs)

    def __len__(self):
        return len(self._report.specs)


class TrainingReport:
    """What :func:`train_and_compare` returns. A fit runs when a result first needs
    it, and is kept: ``base_models`` (name -> model fitted on all rows) needs the
    full fit of that model, ``importances`` (model, rank, feature, importance)
    that of all models; ``models`` (name -> CalibratedModel), ``evaluation``,
    ``roc`` (model, threshold, fps, tps, fpr, tpr) and the best model need those of the
    calibration folds; ``metrics`` (a row per model) needs every fit.
    ``evaluation`` holds the columns of ``metrics`` that need no CV."""

    def __init__(self, data: DataFrame, key: str, specs: list[ModelSpec], feature_names: list[str], sizes: dict,
                 cv_folds: int, calibration_folds: int, parallelism: int, fit_partitions: int, evaluate: str,
                 use_smote: bool, began: float):
        self._data, self._key, self._sizes = data, key, sizes
        self._cv_folds, self._calibration_folds = cv_folds, calibration_folds
        self._parallelism, self._fit_partitions = parallelism, fit_partitions
        self._evaluate, self._use_smote = evaluate, use_smote
        self._tag = "cv" if calibration_folds == cv_folds else "cal"
        self._fitted: dict = {}
        self._took = {s.name: 0.0 for s in specs}   # seconds of a model's fits
        self.specs = {s.name: s for s in specs}
        self.feature_names = feature_names
        self.base_models = BaseModels(self)
        self.n_samples = sum(sizes["cv_fold"].values())
        pos = sum(c for (_, y), c in sizes["cv_fold"].items() if y == 1.0)
        self.churn_rate = pos / self.n_samples if self.n_samples else None
        self._seconds = time.time() - began

    @property
    def total_time_sec(self) -> float:
        """Seconds spent so far on folds, fits and scores."""
        return round(self._seconds, 2)

    def _wanted(self, tag: str) -> list[tuple]:
        folds = {"full": [None], "cv": range(self._cv_folds), "cal": range(self._calibration_folds)}[tag]
        return [(name, tag, i) for name in self.specs for i in folds]

    def _frame(self, column: str, held: int | None) -> DataFrame:
        return self._data if held is None else self._data.where(F.col(column) != held)

    def _resample(self, column: str, held: int | None):
        """T5 on the rows of one fit, shared by the models."""
        key, n = self._key, self._fit_partitions
        frame = self._frame(column, held)
        rows = oversample(frame.select(key, "label", vector_to_array("features").alias("x")), "label", key)
        rows = cut_lineage(rows, "smote").repartition(n, "x").sortWithinPartitions("x", "label")
        rows = rows.select("label", array_to_vector("x").alias("features")).persist(StorageLevel.MEMORY_AND_DISK)
        return rows, {r[0]: r[1] for r in rows.groupBy("label").count().collect()}

    def fits(self, wanted: Sequence[tuple]) -> dict:
        """The fitted models by (name, tag, fold); those not there yet are fitted at
        the same time, boosting first, as its rounds follow one another."""
        began = time.time()
        kinds = ("gbt", "rf", "lr")
        missing = sorted({w for w in wanted if w not in self._fitted},
                         key=lambda w: (kinds.index(self.specs[w[0]].kind), w[1], w[2] or 0))
        if not missing:
            return self._fitted
        column = {"full": "cv_fold", "cv": "cv_fold", "cal": "cal_fold"}
        resampled = {at: self._resample(*at) for at in {(column[tag], i) for _, tag, i in missing}} \
            if self._use_smote else {}

        def fit(name, tag, held):
            start, counts, spec = time.time(), {}, self.specs[name]
            for (f, y), c in self._sizes[column[tag]].items():
                if f != held:
                    counts[y] = counts.get(y, 0) + c
            frame = self._frame(column[tag], held)
            if self._use_smote:
                frame, counts = resampled[column[tag], held]
            model = spec.estimator(sum(counts.values()), "" if held is None else f"_f{held}").fit(
                with_weights(frame, counts=counts))
            return model, time.time() - start

        with ThreadPoolExecutor(max_workers=self._parallelism) as pool:
            jobs = {w: pool.submit(fit, *w) for w in missing}
            for w, job in jobs.items():
                self._fitted[w], took = job.result()
                self._took[w[0]] += took
        for frame, _ in resampled.values():
            frame.unpersist()
        self._seconds += time.time() - began
        return self._fitted

    def _out_of_fold(self, tag: str) -> DataFrame:
        """(model, fold, label, score) of all models over their held-out folds."""
        fitted, held = self.fits(self._wanted(tag)), None
        for name, _, i in self._wanted(tag):
            s = fitted[name, tag, i].transform(self._data.where(F.col(f"{tag}_fold") == i)).select(
                F.lit(name).alias("model"), F.lit(i).alias("fold"), "label",
                self.specs[name].score_expr(f"_f{i}").alias("score"))
            held = s if held is None else held.unionByName(s)
        return cut_lineage(held, f"{tag}-scores")

    @cached_property
    def _cv_scores(self) -> DataFrame:
        return self._out_of_fold("cv")

    @cached_property
    def _cal_scores(self) -> DataFrame:
        return self._cv_scores if self._tag == "cv" else self._out_of_fold("cal")

    @cached_property
    def _platt(self) -> dict:
        """Platt per calibration fold on out-of-fold scores."""
        began, scores = time.time(), self._cal_scores
        counts: dict = {}
        for r in scores.groupBy("model", "fold", "label").count().collect():
            counts.setdefault((r["model"], r["fold"]), {})[r["label"]] = r["count"]
        with ThreadPoolExecutor(max_workers=self._parallelism) as pool:
            coefs = {(name, i): pool.submit(
                platt, scores.where((F.col("model") == name) & (F.col("fold") == i)), "score",
                counts=counts.get((name, i), {}))
                for name in self.specs for i in range(self._calibration_folds)}
            coefs = {k: v.result() for k, v in coefs.items()}
        self._seconds += time.time() - began
        return coefs

    @cached_property
    def models(self) -> dict:
        fitted, coefs, folds = self.fits(self._wanted(self._tag)), self._platt, range(self._calibration_folds)
        return {name: CalibratedModel(spec, [fitted[name, self._tag, i] for i in folds],
                                      [coefs[name, i] for i in folds], self.feature_names)
                for name, spec in self.specs.items()}

    @cached_property
    def _scored(self) -> DataFrame:
        """(label, score, model): calibrated probabilities, for T8-T11."""
        scored = None
        for name, model in self.models.items():
            if self._evaluate == "in_sample":
                own = model.transform(self._data, out="score", keep=["label"])
            else:
                own = self._cal_scores.where(F.col("model") == name).select(
                    "label", held_out_probability(model.platt).alias("score"))
            own = own.withColumn("model", F.lit(name))
            scored = own if scored is None else scored.unionByName(own)
        return cut_lineage(scored, f"{self._evaluate}-scores")

    @cached_property
    def roc(self) -> DataFrame:
        return M.roc_points(self._scored)

    @cached_property
    def _evaluation(self) -> list[tuple]:
        began = time.time()
        auc = {r["model"]: r["auc"] for r in M.auc(self._scored).collect()}
        classes = {r["model"]: r for r in M.classification_metrics(
            self._scored.withColumn("prediction", (F.col("score") > 0.5).cast("int"))).collect()}
        self._seconds += time.time() - began
        return [(name, type(self.models[name].members[0]).__name__, round(auc[name], 4),
                 *[classes[name][c] for c in ("precision", "recall", "f1", "accuracy")]) for name in self.specs]

    @cached_property
    def evaluation(self) -> DataFrame:
        return self._data.sparkSession.createDataFrame(self._evaluation, EVALUATION)

    @cached_property
    def _best(self) -> tuple:
        return max(self._evaluation, key=lambda r: (
            r[2], -FX.MODEL_NAMES.index(r[0]) if r[0] in FX.MODEL_NAMES else 0))

    @property
    def best_model_name(self) -> str:
        return self._best[0]

    @property
    def best_auc(self) -> float:
        return self._best[2]

    @cached_property
    def importances(self) -> DataFrame:
        fitted = self.fits(self._wanted("full"))
        rows = [(name, i + 1, f, v) for name, spec in self.specs.items()
                for i, (f, v) in enumerate(importances(spec, fitted[name, "full", None], self.feature_names))]
        return self._data.sparkSession.createDataFrame(
            rows, "model string, rank int, feature string, importance double")

    @cached_property
    def metrics(self) -> DataFrame:
        # all fits at once, then what follows from them
        self.fits([w for tag in ("full", "cv", self._tag) for w in self._wanted(tag)])
        # Out-of-fold AUC of every model and fold, in one pass
        fold_auc = {(r["model"], r["fold"]): r["auc"]
                    for r in M.auc(self._cv_scores, by=["model", "fold"]).collect()}
        rows = []
        for row in self._evaluation:
            cv_aucs = [fold_auc[row[0], i] for i in range(self._cv_folds)]
            cv_mean = sum(cv_aucs) / len(cv_aucs)
            cv_std = math.sqrt(sum((a - cv_mean) ** 2 for a in cv_aucs) / len(cv_aucs))
            rows.append((*row, round(cv_mean, 4), round(cv_std, 4), round(self._took[row[0]], 2)))
        return self._data.sparkSession.createDataFrame(
            rows, f"{EVALUATION}, cv_auc_mean double, cv_auc_std double, train_time_sec double")


def train_and_compare(X: DataFrame, feature_names: list[str], label: str = "churned",
                      key: str = "client_id", cv_folds: int = 5, calibration_folds: int = 3,
                      specs: list[ModelSpec] | None = None, parallelism: int = 16,
                      fit_partitions: int | None = None, evaluate: str = "hold_out",
                      use_smote: bool = False) -> TrainingReport:
    """CV AUC, full fit, metrics of the calibrated models, ROC, importances.

    ``evaluate="hold_out"`` scores each row by the calibration fold's model that
    has not seen it, through the sigmoids of the other folds, which have not
    seen it either. ``"in_sample"`` scores the fitting rows by the calibrated
    ensemble. ``use_smote`` oversamples the rows of each fit. The result depends on
    ``fit_partitions`` (by default one per FIT_ROWS rows, FIT_PARTITIONS at least)
    but not on the cluster. The fits run as the report's results are read."""
    if evaluate not in ("hold_out", "in_sample"):
        raise ValueError("evaluate is hold_out or in_sample")
    if calibration_folds < 2:
        raise ValueError("calibration needs two folds at least")
    began = time.time()
    specs = specs or default_specs()
    data = with_features(X, feature_names).select(key, "features", F.col(label).cast("double").alias("label"))
    data = with_folds(cut_lineage(data, "training"), key, "label", cv_folds, SEED, "cv_fold")
    data = with_folds(data, key, "label", calibration_folds, SEED + 1, "cal_fold")
    data = cut_lineage(data, "training")
    # rows per label and fold: at most 2 x folds numbers per fold column
    sizes = {f: {(r[0], r[1]): r[2] for r in data.groupBy(f, "label").count().collect()}
             for f in ("cv_fold", "cal_fold")}
    if any(not any(y == side for _, y in sizes["cv_fold"]) for side in (0.0, 1.0)):
        raise ValueError("training data needs both classes")
    if any((i, y) not in sizes["cv_fold"] for i in range(cv_folds) for y in (0.0, 1.0)):
        raise ValueError(f"{specs[0].name}: a CV fold lacks one of the classes")
    # bagging and row sampling are seeded per partition: the same rows in the
    # same order in the same partitions give the same model on any cluster. The
    # checkpoint keeps partitions and order for fits that run later.
    n = sum(sizes["cv_fold"].values())
    fit_partitions = fit_partitions or max(FIT_PARTITIONS, -(-n // FIT_ROWS))
    dealt = data.repartition(fit_partitions, key).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)
    data = dealt.checkpoint()
    dealt.unpersist()
    return TrainingReport(data, key, specs, feature_names, sizes, cv_folds, calibration_folds, parallelism,
                          fit_partitions, evaluate, use_smote, began)


def predict_churn(model: CalibratedModel, X: DataFrame, key: str = "client_id") -> DataFrame:
    """``(key, churn_prob)`` for new rows."""
    return model.transform(X, keep=[key])

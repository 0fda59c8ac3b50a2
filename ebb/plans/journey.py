"""The whole retention analysis of one client table, as the reference app's
steps run in order: profile -> repair -> RFM -> features -> models -> attribution
-> recommendations -> dashboard -> drift -> report.

Every step is an operator of this library; this module only wires them and
cuts lineage once after the repair, so the later statistics jobs, the model fits
and the scoring read a written table instead of recomputing the source joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as FX
from ..operators import actions, drift, explain, features, metrics, models, profile, repair, rfm
from ..session import cut_lineage
from ..sources import sinks


@dataclass
class RetentionAnalysis:
    health: profile.HealthReport
    clean: DataFrame
    rfm: DataFrame
    segment_stats: DataFrame
    feature_model: features.FeatureModel
    X: DataFrame
    training: models.TrainingReport
    attributions: DataFrame
    base_value: float
    explanations: DataFrame
    recommendations: DataFrame
    kpi: DataFrame
    segment_cards: DataFrame
    drift: DataFrame
    drift_alerts: DataFrame
    summary: DataFrame
    report: DataFrame


def analyze_clients(df: DataFrame, key: str = "client_id", target: str = "churned",
                    churn_threshold: float = 0.5, cv_folds: int = 5, calibration_folds: int = 3, permutations: int = 8,
                    specs: list[models.ModelSpec] | None = None) -> RetentionAnalysis:
    health = profile.profile_dataframe(df)
    clean = cut_lineage(repair.auto_fix_dataframe(df, health), "clean")
    scored_rfm = rfm.compute_rfm(clean)
    stats = rfm.segment_stats(scored_rfm)
    fm = features.FeatureEngineer(target).fit(clean)
    X = cut_lineage(fm.transform(clean), "features")
    rep = models.train_and_compare(X, fm.features, label=target, key=key, cv_folds=cv_folds,
                                   calibration_folds=calibration_folds, specs=specs)
    best = rep.best_model_name
    probs = rep.models[best].transform(X, keep=[key])
    fn = explain.model_score_fn(rep.base_models[best], rep.models[best].spec.kind)
    contribs, base = explain.permutation_contributions(fn, X, fm.features, key=key,
                                                       permutations=permutations)
    contribs = cut_lineage(contribs, "attributions")
    expl = explain.explain_clients(contribs, base, key=key,
                                   space=explain.score_space(rep.models[best].spec.kind))
    advice = actions.factor_advice(explain.top_risk_factor_names(contribs, key), key=key)
    recs = actions.generate_recommendations(scored_rfm, probs, churn_threshold=churn_threshold)
    recs = recs.join(advice, key, "left").orderBy(
        actions.urgency_rank("alpha"), (F.col("ltv") * F.col("churn_prob")).desc(), key)
    kpi = actions.kpi_row(recs)
    half_a, half_b = drift.split_halves(X, key)
    drift_table = drift.detect_drift(half_a.drop(key, target), half_b.drop(key, target), fm.features)
    best_row = metrics.best_model(rep.metrics, FX.MODEL_NAMES)
    auc = best_row.select(F.col("best_auc").alias("auc"))
    top = explain.global_importance(contribs).limit(1)
    return RetentionAnalysis(
        health, clean, scored_rfm, stats, fm, X, rep, contribs, base, expl, recs, kpi,
        actions.segment_cards(recs), drift_table, drift.drift_alerts(drift_table),
        actions.executive_summary(stats, kpi, auc, top),
        sinks.report_lines(kpi, stats, recs, best_row))

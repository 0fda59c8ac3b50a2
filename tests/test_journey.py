"""The composed analysis runs end to end on the sample frame."""
from ebb.operators import models
from ebb.plans.journey import analyze_clients


def test_analyze_clients(sample_df):
    specs = models.default_specs({"Random Forest": {"numTrees": 20}, "XGBoost": {"maxIter": 10}})
    a = analyze_clients(sample_df, cv_folds=2, permutations=2, specs=specs)
    assert a.recommendations.count() == sample_df.count()
    assert a.explanations.count() == sample_df.count()
    assert a.summary.count() == 1 and "AUC-ROC" in a.summary.first()["summary"]
    assert a.report.where("section = 'top_clients'").count() == 10
    assert a.drift.count() == len(a.feature_model.features)
    assert a.clean.where("total_revenue IS NULL").count() == 0

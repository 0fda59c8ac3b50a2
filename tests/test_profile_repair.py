"""Profiling (P1-P8) and repair (F1-F5), with hand tables for the quirks."""
import datetime as dt

from pyspark.sql import functions as F

from ebb.operators.profile import profile_dataframe
from ebb.operators.repair import auto_fix_dataframe


def test_profile_dataframe(sample_df):
    rep = profile_dataframe(sample_df)
    t = rep.table.first()
    assert 0 <= t["overall_score"] <= 100
    assert rep.columns.count() == len(sample_df.columns)


def test_auto_fix_fills_injected_null(sample_df):
    dirty = sample_df.withColumn("total_revenue", F.when(F.col("support_tickets") == 0, None)
                                 .otherwise(F.col("total_revenue")))
    fixed = auto_fix_dataframe(dirty)
    assert fixed.where(F.col("total_revenue").isNull()).count() == 0
    assert fixed.count() == dirty.count()


def test_edge_table(spark):
    rows = [(1, 5.0, None, "a", True, dt.date(2024, 1, 1)),
            (2, 5.0, None, "b", None, None),
            (3, 5.0, None, "b", False, dt.date(2024, 1, 2)),
            (3, 5.0, None, "b", False, dt.date(2024, 1, 2)),     # duplicate row
            (4, 5.0, None, None, True, dt.date(2024, 1, 2))]
    df = spark.createDataFrame(rows, "k int, const double, allnull double, cat string, flag boolean, d date")
    rep = profile_dataframe(df)
    cols = {r["column"]: r for r in rep.columns.collect()}
    assert cols["const"]["outlier_count"] == 0                   # zero IQR -> no outliers
    assert any("одинаковы" in i for i in cols["const"]["issues"])  # constant column flagged
    assert cols["allnull"]["missing_pct"] == 100.0
    assert cols["allnull"]["unique_pct"] == 0.0
    t = rep.table.first()
    assert t["duplicate_rows"] == 1
    assert any("allnull" in g for g in t["global_issues"])
    fixed = auto_fix_dataframe(df, rep).collect()
    assert len(fixed) == 4                                       # duplicate dropped
    by_k = {r["k"]: r for r in fixed}
    assert by_k[4]["cat"] == "b"                                 # mode of the strings
    assert by_k[2]["flag"] is True                               # True twice, False once
    assert by_k[2]["d"] == dt.date(2024, 1, 2)                   # mode of dates


def test_outlier_fences_strict(spark):
    # q1=2.75, q3=6.25 (linear), fences -2.5 and 11.5: only 100 is outside
    vals = [(float(x),) for x in [1, 2, 3, 4, 5, 6, 7, 100]]
    rep = profile_dataframe(spark.createDataFrame(vals, "v double"))
    r = rep.columns.first()
    assert r["outlier_count"] == 1

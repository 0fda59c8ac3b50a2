"""Sources and sinks (S1-S9) and the mart."""
import pytest
from pyspark.sql import functions as F

from ebb.sources import csv_io, sinks
from ebb.sources.marts import client_mart


def test_detect_delimiters(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,3\n4,5,6")
    (tmp_path / "b.csv").write_text("x;y\n1;2\n3;4\n")
    (tmp_path / "c.csv").write_text("p|q|r|s\n1|2|3|4\n")
    got = {r["file"].rsplit("/", 1)[-1]: r["delimiter"] for r in csv_io.csv_dialects(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ",", "b.csv": ";", "c.csv": "|"}


def test_load_csv_normalises(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Customer ID;Last Login;Churn\nA;2024-01-02;1\nB;oops;0\n")
    df = csv_io.load_csv(spark, str(tmp_path))
    assert df.columns == ["client_id", "activity_date", "churned"]
    rows = {r["client_id"]: r["activity_date"] for r in df.collect()}
    assert rows["B"] is None and rows["A"] is not None


def test_synonym_collision_raises(spark):
    df = spark.createDataFrame([(1, 2)], "customer_id int, user_id int")
    with pytest.raises(ValueError):
        csv_io.normalize_columns(df)


def test_validate_columns():
    ok, missing, _ = csv_io.validate_columns(["client_id", "activity_date", "churned", "total_orders"])
    assert ok and missing == []
    ok, missing, _ = csv_io.validate_columns(["x", "y"])
    assert not ok and "client_id" in missing


def test_mart_and_export(spark, tmp_path):
    m = client_mart(spark, "/root/testdata/sf0.001")
    assert m.count() == 150 and m.select("client_id").distinct().count() == 150
    share = m.agg(F.avg("churned")).first()[0]
    assert 0.1 < share < 0.35
    recs = m.select("client_id", F.lit("Loyal").alias("rfm_segment"), F.lit(0.3).alias("churn_prob"),
                    F.lit("low").alias("churn_risk_level"), F.lit(1.0).alias("ltv"))
    path = sinks.export_predictions(recs, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["client_id", "rfm_segment", "churn_prob", "churn_risk_level", "ltv"]
    assert back.count() == 150


def test_load_dataset_and_validation_report(spark):
    m = csv_io.load_dataset(spark, "client_mart", "/root/testdata/sf0.001")
    assert m is not None and "client_id" in m.columns
    assert csv_io.load_dataset(spark, "no_such_dataset", "/root/testdata/sf0.001") is None
    assert csv_io.load_dataset(spark, "region", "/root/testdata/sf0.001").count() == 5
    rep = {(r["kind"], r["column"]) for r in csv_io.validation_report(m).collect()}
    assert not any(k == "required" for k, _ in rep)            # the mart has the required columns
    assert ("recommended", "monthly_fee") in rep


def test_mixed_delimiters(spark, tmp_path):
    (tmp_path / "a.csv").write_text("client_id,churned\n1,0\n2,1\n")
    (tmp_path / "b.csv").write_text("client_id;churned\n3;0\n4;1\n")
    rows = csv_io.load_csv(spark, str(tmp_path)).collect()
    assert {(str(r["client_id"]), int(r["churned"])) for r in rows} == {("1", 0), ("2", 1), ("3", 0), ("4", 1)}

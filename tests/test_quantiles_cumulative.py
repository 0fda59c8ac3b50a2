"""Exact distributed quantiles and range-bucketed prefix sums."""
import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebb.functions.cumulative import place, prefix_sums
from ebb.functions.quantiles import quantiles

PROBS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("accuracy", [20, 10000])
@pytest.mark.parametrize("kind", ["doubles", "ties", "small", "hot"])
def test_quantiles_match_quantile_cont(spark, accuracy, kind):
    rng = np.random.default_rng(7)
    if kind == "doubles":
        v = rng.lognormal(3, 1, 3000)
    elif kind == "ties":
        v = rng.integers(0, 5, 3000).astype(float)   # a hot value holds ~1/5 of rows
    elif kind == "hot":
        # one value holds a third of all rows
        v = np.where(rng.random(3000) < 1 / 3, 42.0, rng.normal(40, 5, 3000))
    else:
        v = rng.normal(0, 1, 7)
    g = np.array(["a", "b", "c"])[rng.integers(0, 3, len(v))]
    pdf = pd.DataFrame({"g": g, "v": v})
    got = {r["g"]: r["edges"] for r in quantiles(spark.createDataFrame(pdf), "v", PROBS, by=["g"],
                                                    accuracy=accuracy).collect()}
    want = dict(duckdb.sql(f"select g, quantile_cont(v, {PROBS}) from pdf group by g").fetchall())
    assert got == want


def test_quantiles_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), (1.0,), (float("nan"),), (3.0,)], "v double")
    r = quantiles(df, "v", [0.5]).first()
    assert r["n"] == 2 and r["edges"] == [2.0]
    e = quantiles(df.where("v > 100"), "v", [0.5]).first()
    assert e["n"] == 0 and e["edges"] is None


def test_prefix_sums_match_cumsum(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 2000), "x": rng.permutation(2000).astype(float),
                        "c": rng.integers(1, 9, 2000)})
    out = prefix_sums(spark.createDataFrame(pdf), ["g"], "x", ["c"], rows_per_bucket=100).toPandas()
    pdf = pdf.sort_values(["g", "x"])
    pdf["want"] = pdf.groupby("g")["c"].cumsum()
    m = out.merge(pdf, on=["g", "x", "c"])
    assert len(m) == 2000 and (m["cum_c"] == m["want"]).all()
    desc = prefix_sums(spark.createDataFrame(pdf[["g", "x", "c"]]), ["g"], "x", ["c"], descending=True).toPandas()
    pdf = pdf.sort_values(["g", "x"], ascending=[True, False])
    pdf["want_d"] = pdf.groupby("g")["c"].cumsum()
    m = desc.merge(pdf, on=["g", "x", "c"])
    assert (m["cum_c"] == m["want_d"]).all()


def test_quantiles_without_group_broadcast(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.integers(0, 50, 2000), "v": rng.normal(0, 1, 2000)})
    a = {r["g"]: r["edges"] for r in quantiles(spark.createDataFrame(pdf), "v", [0.1, 0.5], by=["g"]).collect()}
    b = {r["g"]: r["edges"] for r in quantiles(spark.createDataFrame(pdf), "v", [0.1, 0.5], by=["g"],
                                                  broadcast_groups=True).collect()}
    assert a == b and len(a) == 50


def test_prefix_sums_of_many_groups(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 40, 1000), "x": rng.permutation(1000).astype(float), "c": 1})
    pdf.loc[pdf["g"] == 39, "g"] = None   # a null group is a group
    a = prefix_sums(spark.createDataFrame(pdf), ["g"], "x", ["c"]).toPandas().sort_values(["g", "x"])
    b = prefix_sums(spark.createDataFrame(pdf), ["g"], "x", ["c"], rows_per_bucket=10).toPandas() \
        .sort_values(["g", "x"])
    assert len(a) == 1000 and list(a["cum_c"]) == list(b["cum_c"])


def test_no_window_holds_a_share_of_the_rows(spark):
    """One group of 20,000 rows: the largest (group, range) stays near the bound."""
    df = spark.range(20000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x"))
    assert place(df, ["g"], "x", rows_per_bucket=500).groupBy("g", "_b").count().agg(F.max("count")).first()[0] < 1500


def test_quantiles_with_narrow_ranges(spark):
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"v": rng.lognormal(3, 1, 4000)})
    got = quantiles(spark.createDataFrame(pdf), "v", PROBS, accuracy=5, rows_per_bucket=20).first()["edges"]
    assert got == duckdb.sql(f"select quantile_cont(v, {PROBS}) from pdf").fetchall()[0][0]

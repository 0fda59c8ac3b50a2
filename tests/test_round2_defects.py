"""Cases that once gave wrong rows, lost groups or crashed: CSV files of several
shapes, clashing names, groups without values."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ebb.functions.quantiles import quantiles, weighted_quantiles
from ebb.operators import features, profile
from ebb.operators.repair import auto_fix_dataframe
from ebb.sources import csv_io


def rows(df, *cols):
    return sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("schema", [None, "client_id long, churned int"])
def test_columns_in_another_order(spark, tmp_path, schema):
    (tmp_path / "a.csv").write_text("client_id,churned\n1,0\n")
    (tmp_path / "b.csv").write_text("churned,client_id\n1,7\n")
    (tmp_path / "c.csv").write_text("Churn;note;Customer ID\n0;x;9\n")
    s = spark.createDataFrame([], schema).schema if schema else None
    df = csv_io.load_csv(spark, str(tmp_path), schema=s)
    assert rows(df, "client_id", "churned") == [("1", "0"), ("7", "1"), ("9", "0")]
    if schema:
        assert df.columns == ["client_id", "churned"]
        with pytest.raises(ValueError):
            csv_io.load_csv(spark, str(tmp_path), schema=spark.createDataFrame([], "other int").schema)


def test_quoted_breaks_quotes_and_delimiters(spark, tmp_path):
    (tmp_path / "a.csv").write_text('client_id,note,churned\n1,"one\ntwo; ""three"", four",0\n2,plain,1\n')
    df = csv_io.load_csv(spark, str(tmp_path))
    assert rows(df, "client_id", "note", "churned") == [("1", 'one\ntwo; "three", four', "0"), ("2", "plain", "1")]


def test_encodings_and_a_space_in_the_path(spark, tmp_path):
    folder = tmp_path / "my [files] 1"
    folder.mkdir()
    (folder / "a b.csv").write_bytes("client_id;name\n1;Zoë\n".encode())
    (folder / "b.csv").write_bytes("﻿client_id,name\n2,Jürgen\n".encode())
    (folder / "c.csv").write_bytes("client_id|name\n3|François\n".encode("latin-1"))
    (folder / "empty.csv").write_bytes(b"")
    found = {r["file"].rsplit("/", 1)[-1]: (r["delimiter"], r["encoding"])
             for r in csv_io.csv_dialects(spark, csv_io._literal(str(folder))).collect()}
    assert found["a b.csv"] == (";", "utf-8") and found["b.csv"] == (",", "utf-8-sig") and found["c.csv"] == ("|", "latin-1")
    df = csv_io.load_csv(spark, csv_io._literal(str(folder)))
    assert rows(df, "client_id", "name") == [("1", "Zoë"), ("2", "Jürgen"), ("3", "François")]
    (folder / "c.csv").unlink()
    for f in ("a b.csv", "b.csv"):
        (folder / f).unlink()
    assert csv_io.load_csv(spark, csv_io._literal(str(folder))) is None


def test_heads_are_bounded(spark, tmp_path):
    """A character and a record cut off by the end of the head are no faults."""
    text = "client_id,name\n" + "".join(f"{i},ä\n" for i in range(2000))
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    for n in (16, 17, 18, 19, 40, 41, 42, 43):
        r = csv_io.csv_dialects(spark, str(tmp_path), head_bytes=n).first()
        assert (r["delimiter"], r["encoding"], r["header"]) == (",", "utf-8", ["client_id", "name"])
    path = str(tmp_path / "a.csv")
    assert len(csv_io.read_head(path, 100)) == 101
    assert csv_io.load_csv(spark, str(tmp_path)).count() == 2000


def test_compressed_files(spark, tmp_path):
    import gzip
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"client_id;churned\n5;1\n"))
    assert rows(csv_io.load_csv(spark, str(tmp_path)), "client_id", "churned") == [("5", "1")]


@pytest.mark.parametrize("name", ["c", "a b.c"])
def test_any_column_name_is_profiled(spark, name):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (90, "y")], f"`{name}` int, other string")
    rep = profile.profile_dataframe(df)
    assert rep.table.first()["duplicate_rows"] == 1
    assert [r["column"] for r in rep.columns.orderBy("ordinal").collect()] == [name, "other"]
    assert auto_fix_dataframe(df).count() == 3


def test_feature_names_are_unique(spark):
    cats = ["p", "q", "r"]
    df = spark.createDataFrame([(i, cats[i % 3], cats[i % 3].upper(), float(i), i % 2) for i in range(12)],
                               "client_id int, c string, d string, c_q double, churned int")
    X, names, model = features.engineer_features(df)
    assert len({n.lower() for n in names}) == len(names) and "c_q" in names and "c_q_" in names
    assert X.select(*[F.col(f"`{n}`") for n in names]).count() == 12
    raw = features.FeatureModel.from_json(model.to_json())
    raw.scaled = False
    got = {r["client_id"]: (r["c_q"], r["c_q_"]) for r in raw.transform(df).collect()}
    assert got[4] == (4.0, 1.0) and got[5] == (5.0, 0.0)


def test_groups_without_values_and_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0), (None, 7.0), ("c", float("nan"))], "g string, v double")
    for method in ("exact", "approx"):
        got = {r["g"]: (r["n"], r["edges"]) for r in quantiles(df, "v", [0.0, 1.0], by=["g"], method=method).collect()}
        assert got == {"a": (2, [1.0, 3.0]), "b": (0, None), None: (2, [5.0, 7.0]), "c": (0, None)}
    short = quantiles(df, "v", [0.5], by=["g"], empty_groups=False)
    assert {r["g"]: r["edges"] for r in short.collect()} == {"a": [2.0], None: [6.0]}


def test_weighted_quantiles_equal_those_of_the_rows(spark):
    rng = np.random.default_rng(1)
    data = [(g, float(v)) for g in ("a", None) for v in rng.integers(0, 40, 500)] + [("one", 3.5)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.99, 1.0]
    counts = df.groupBy("g", "v").agg(F.count("*").alias("c"))
    got = {r["g"]: (r["n"], r["edges"]) for r in weighted_quantiles(counts, "v", "c", probs, ["g"], rows_per_bucket=7).collect()}
    want = {r["g"]: (r["n"], r["edges"]) for r in quantiles(df, "v", probs, by=["g"]).collect()}
    assert got == want and len(got) == 3

"""What a task of the mart's joins holds must not grow with the source tables."""
import pytest

from ebb import session
from ebb.plans import catalog
from ebb.sources.marts import client_mart, events_mart

SF = "/root/testdata/sf0.001"
KEYS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.mark.parametrize("which,build,table", [("client", client_mart, "lineitem"), ("events", events_mart, "events")])
def test_mart_shuffles_grow_with_the_source(spark, monkeypatch, which, build, table):
    rows, seen = spark.read.parquet(f"{SF}/{table}.parquet").count(), []
    write = catalog.cut_lineage
    monkeypatch.setattr(session, "SHUFFLE_ROWS", -(-rows // 20), raising=False)
    monkeypatch.setattr(catalog, "_MARTS", {})
    monkeypatch.setattr(catalog, "cut_lineage", lambda df, name: seen.append(spark.conf.get(KEYS[0])) or write(df, name))
    before = [spark.conf.get(k, None) for k in KEYS]
    got = catalog._mart(spark, SF, which)
    assert 18 <= int(seen[0]) <= 20
    assert [spark.conf.get(k, None) for k in KEYS] == before
    assert sorted(map(repr, got.collect())) == sorted(map(repr, build(spark, SF).collect()))


def test_small_tables_keep_the_sessions_shuffles(spark):
    before = [spark.conf.get(k, None) for k in KEYS]
    with session.sized_shuffles(spark, 1000):
        assert [spark.conf.get(k, None) for k in KEYS] == before
    with pytest.raises(ValueError), session.sized_shuffles(spark, 1 << 40):
        raise ValueError
    assert [spark.conf.get(k, None) for k in KEYS] == before

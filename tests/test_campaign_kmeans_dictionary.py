"""Campaign values, clusters and the dictionary check on small tables."""
import numpy as np
import pytest

from ebb.operators import campaign, dictionary, kmeans


def test_lift_shares_ties_at_the_edge(spark):
    # 20 rows: the top 10 % are two rows, and the edge cuts through four rows of one score
    rows = [(1, 0.9)] + [(1, 0.8), (1, 0.8), (0, 0.8), (0, 0.8)] + [(0, 0.1)] * 14 + [(1, 0.05)]
    r = campaign.lift_top_share(spark.createDataFrame(rows, "label int, score double")).first()
    assert (r["n_rows"], r["n_positive"]) == (20, 4)
    assert r["top_positive"] == pytest.approx(1 + 2 * 1 / 4) and r["lift"] == pytest.approx((1.5 / 2) / (4 / 20))
    none = campaign.lift_top_share(spark.createDataFrame([(0, 0.5)] * 5, "label int, score double")).first()
    assert none["lift"] is None and none["top_positive"] == 0


def test_money_saved(spark):
    rows = [(1, 0.9, 100.25), (1, 0.4, 50.0), (0, 0.8, 70.0), (1, 0.6, None)]
    got = {r["threshold"]: tuple(r)[1:] for r in campaign.money_saved(spark.createDataFrame(rows, "label int, score double, ltv double")).collect()}
    assert got == {0.3: (4, 3, 150.25, 0.0), 0.5: (3, 2, 100.25, 50.0), 0.7: (2, 1, 100.25, 50.0)}


def test_retention_roi(spark):
    recs = spark.createDataFrame([(i, float(i) - 2) for i in range(30)], "client_id long, roi_estimate double")
    got = {r["top_n"]: (r["n_clients"], r["roi"]) for r in campaign.retention_roi(recs, (1, 3, 100)).collect()}
    assert got == {1: (1, 27.0), 3: (3, 78.0), 100: (30, float(sum(range(30)) - 60))}


def plain_plan(offers, budget):
    rows = sorted((-(v / c), k, c, v) for k, c, v in offers if c > 0 and v > 0)
    out, left = [], budget
    for nth in (1, 2):
        run, rest = 0, []
        limit = left
        rows = rows if nth == 1 else [r for r in rows if r[2] <= limit]
        for r in rows:
            run += r[2]
            if run <= limit:
                out.append((r[1], r[2], r[3], nth))
                left -= r[2]
            else:
                rest.append(r)
        rows = rest
    return sorted(out)


@pytest.mark.parametrize("budget", [0, 35, 400, 10 ** 6])
def test_budget_plan(spark, budget):
    rng = np.random.default_rng(budget)
    offers = [(i, int(c), int(v)) for i, (c, v) in enumerate(zip(rng.integers(0, 60, 80), rng.integers(-5, 90, 80), strict=True))]
    df = spark.createDataFrame(offers, "client_id long, cost long, value long")
    got = sorted(map(tuple, campaign.budget_plan(df, budget).collect()))
    assert got == plain_plan(offers, budget) and sum(c for _, c, _, _ in got) <= budget


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((40, 2)) + c for c in ((0, 0), (20, 0), (0, 20))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "client_id long, a double, b double")
    start = kmeans.seed_centres(df, ["a", "b"], 3)
    assert len(start) == 3 and start == kmeans.seed_centres(df.repartition(5), ["a", "b"], 3)
    centres, inertia = kmeans.kmeans_fit(df, ["a", "b"], start, 20)
    assert all(b <= a * (1 + 1e-12) for a, b in zip(inertia, inertia[1:], strict=False))
    seg = {r["client_id"]: r["cluster"] for r in kmeans.kmeans_segments(df, ["a", "b"], centres).collect()}
    assert {len({seg[i] for i in range(g * 40, g * 40 + 40)}) for g in range(3)} == {1} and len(set(seg.values())) == 3
    assert kmeans.seed_centres(df.where("false"), ["a", "b"], 3) == []
    same = df.selectExpr("client_id", "1.0 AS a", "2.0 AS b")
    assert kmeans.seed_centres(same, ["a", "b"], 3) == [[1.0, 2.0]]


def test_dictionary(spark):
    values = ["gold", "silver", "gold", "glod", "slver", "xx", "", None, "goldie", "GOLD"]
    df = spark.createDataFrame([(v,) for v in values], "tier string")
    entries = spark.createDataFrame([("gold",), ("silver",), ("old",), (None,)], "entry string")
    got = {r["value"]: tuple(r)[1:] for r in dictionary.dictionary_check(df, "tier", entries).collect()}
    assert got == {"glod": (1, "gold", 2), "slver": (1, "silver", 1), "xx": (1, None, None), "": (1, None, None),
                   "goldie": (1, "gold", 2), "GOLD": (1, None, None)}

"""Suffix-array dedup, Merkle manifest and embedding whitening against plain
versions, on tables with nulls, ties, repeated rows and clashing names."""
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ebb.llm import common, merkle, queries, suffix_dedup, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, uid long, key string, body string, start int"


# --- suffix arrays -------------------------------------------------------------

@pytest.mark.parametrize("depth", [64, 65, 133, 400])
@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh "])
def test_sorted_buckets_and_repeats(depth, letters, monkeypatch):
    rnd = random.Random(depth)
    base = bytes(rnd.choice(letters) for _ in range(1200))
    cuts = [(rnd.randint(0, 600), rnd.randint(30, 700)) for _ in range(6)]
    text = b"".join(base[a:a + n] for a, n in cuts) + b"x" * 600 + bytes(500) + base[:300]
    starts = np.arange(len(text) - depth + 1)
    block = np.frombuffer(text, dtype=np.uint8)
    order, _ = suffix_dedup.sort_bucket(suffix_dedup.CoverSample(block, depth), starts)
    heads = [text[a:a + depth] for a in order]
    assert heads == sorted(heads)
    seen = Counter(text[a:a + depth] for a in starts)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 128)
    assert suffix_dedup.repeated(block, starts, depth).tolist() == [seen[text[a:a + depth]] > 1 for a in starts]


def plain_suffix_dedup(rows, depth):
    seen = Counter(b[s:s + depth] for _, b in rows for s in range(len(b) - depth + 1))
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - depth + 1):
            if seen[b[s:s + depth]] > 1:
                gone[s:s + depth] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        out.append((i, len(b), np.frombuffer(b, dtype=np.uint8)[~gone].tobytes(),
                    list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages(spark):
    """A passage in a third of the rows with other words around it, copies, self-repeats, long and short texts."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    common_text, other = say(40), say(60)
    rows = [(i, f"{say(rnd.randint(1, 20))} {common_text} {say(rnd.randint(1, 20))}") for i in range(30)]
    rows += [(100 + i, other.replace(" ", "  ", i)) for i in range(12)]      # near copies
    rows += [(200 + i, say(rnd.randint(1, 80))) for i in range(20)]
    rows += [(300, "ab" * 300), (301, "=" * 900), (302, say(30) * 3), (303, say(4000)), (304, ""), (305, None),
             (306, "Grüße 日本語 " * 30), (307, "short"), (308, common_text[7:]), (308, common_text[7:]),
             (None, other), (None, other), (None, None)]
    return spark.createDataFrame([(i, t, 1, "k", "b", 2) for i, t in rows], DOCS).repartition(3)


@pytest.mark.parametrize("depth,shard", [(64, 4096), (64, 2), (100, 5), (400, 2)])
def test_suffix_dedup(passages, depth, shard):
    got = suffix_dedup.suffix_dedup(passages, depth=depth, shard=shard).collect()
    got = [(r["doc_id"], r["n_bytes"], bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in got]
    want = plain_suffix_dedup([(r["doc_id"], (r["text"] or "").encode()) for r in passages.collect()], depth)
    assert sorted(got, key=repr) == want


def test_long_texts_are_read_in_pieces(passages, monkeypatch):
    bodies = [(r["text"] or "").encode() for r in passages.collect()]
    whole = {(r, s + k): key for row, start, n, _, keys, _ in suffix_dedup.find_segments(bodies, 64)
             for r, s, c, key in zip(row, start, n, keys, strict=True) for k in range(c)}
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    cut = {(r, s + k): key for row, start, n, _, keys, _ in suffix_dedup.find_segments(bodies, 64)
           for r, s, c, key in zip(row, start, n, keys, strict=True) for k in range(c)}
    assert whole == cut and len(whole) == sum(max(0, len(b) - 63) for b in bodies)


def test_op11_on_the_small_table(spark):
    got = sorted(map(tuple, queries.op11_suffix_array_dedup(spark, SF).collect()))
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in common.table(spark, SF, "documents").collect()]
    want = [(i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
            for i, n, kept, spans in plain_suffix_dedup(rows, 400)]
    assert got == sorted(want)


# --- Merkle manifest -------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i:i + 8]) for i in range(0, len(last), 8)])
    return levels


def plain_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*[enc(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = plain_tree([leaf(r) for r in groups[g]])
    top, out = plain_tree([trees[g][-1][0] for g in langs]), []
    for at, g in enumerate(langs):
        for pos, r in enumerate(groups[g]):
            seen, proof = leaf(r), ""
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                seen = leaf({**r, "text": r["text"] and r["text"].translate(lower)})
            for levels, p in ((trees[g], pos), (top, at)):
                for level in levels[:-1]:
                    run = level[p // 8 * 8:p // 8 * 8 + 8]
                    before, after = run[:p % 8], run[p % 8 + 1:]
                    proof += "".join(before + after)
                    seen = H(*before, seen, *after)
                    p //= 8
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], H(proof), seen, seen == top[-1][0]))
    return sorted(out, key=repr)


MERKLE = "doc_id long, source string, lang string, n_chars long, text string, g string, pos long, root string, __uid string"


def merkle_rows(sizes):
    out = []
    for lang, n in sizes.items():
        out += [dict(doc_id=i * 7 % 1000 if i % 11 else None, source="s" if i % 5 else None, lang=lang,
                     n_chars=i if i % 4 else None, text=f"Text Ä {i}" if i % 6 else None) for i in range(n)]
    return out


@pytest.mark.parametrize("height", [1, 2, 4])
def test_merkle_manifest(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 8 ** height)
    rows = merkle_rows({None: 9, "": 1, "de": 64, "en": 8, "fr": 65, "ünï": 130, "zz": 17}) + [
        dict(doc_id=5, source="s", lang="de", n_chars=1, text="Same")] * 20
    df = spark.createDataFrame([(*r.values(), "x", 1, "y", "z") for r in rows], MERKLE).repartition(4)
    # workers import the module anew, so the height goes with the appender of the driver only through the plain run below
    got = sorted(map(tuple, merkle.verified_documents(df).collect()), key=repr) if height == 4 else None
    if got is not None:
        assert got == plain_manifest(rows)
    for n in (1, 7, 8, 9, 64, 65, 130):
        digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        blocks = [digests[i:i + 8 ** height] for i in range(0, n, 8 ** height)]
        paths, alone = [], len(blocks) == 1 and n < 8 ** height
        roots = []
        for b in blocks:
            tree = merkle.Appender()
            for d in b:
                tree.append(d)
            roots.append(tree.finish(alone))
            paths += [bytes(w) for w in tree.witness]
        levels = plain_tree([d.hex() for d in digests])
        if alone or len(roots) == 1:
            assert roots[0].hex() == levels[-1][0]
            assert {merkle.fold(d, w) for d, w in zip(digests, paths, strict=True)} == {roots[0]}
        else:
            assert [r.hex() for r in roots] == levels[height]


def test_merkle_over_several_tiers(spark):
    """More rows than a block holds, so that block roots are appended in a further tier."""
    n = merkle.BLOCK + 70
    rows = [dict(doc_id=i, source=None, lang="en" if i % 50 else "de", n_chars=i, text=f"T{i}") for i in range(n)]
    df = spark.createDataFrame([(*r.values(),) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, merkle.verified_documents(df).collect()), key=repr) == plain_manifest(rows)


def test_merkle_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(None, None, None, None, None)], MERKLE.split(", g")[0])
    leaf = H("-" * 5)
    assert [tuple(r) for r in merkle.verified_documents(one).collect()] == [(None, leaf, leaf, leaf, H(), leaf, True)]
    assert merkle.verified_documents(one.where("false")).collect() == []


# --- whitening --------------------------------------------------------------------

VECS = "vec_id long, embedding array<float>, x string, n string, white string, d int"


def plain_whitening(rows, weights="one"):
    xs = {}
    for i, v in rows:
        if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v):
            xs.setdefault(len(v), []).append((i, tuple(math.floor(64 * float(c)) + 1000000 for c in v)))
    out = []
    for d, own in xs.items():
        fit = sorted(set(x for _, x in own)) if weights == "one" else [x for _, x in own]
        n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        centred = lambda x: np.array([n * a - b for a, b in zip(x, s, strict=True)], dtype=float) / n
        c = np.array([centred(x) for x in fit])
        e, u = np.linalg.eigh(c.T @ c / n)
        e, u = e[::-1], u[:, ::-1]
        for i, x in own:
            dev = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
            y = centred(x) @ u
            out.append((i, n, dev, [abs(y[k]) / math.sqrt(e[k]) if e[k] > 1e-9 else None for k in range(min(16, d))],
                        [max(v, 0) / e.sum() if e.sum() > 0 else None for v in e[:16]]))
    return sorted(out, key=lambda r: repr(r[:3]))


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(2)
    base = [rnd.standard_normal(20).tolist() for _ in range(60)] + [rnd.standard_normal(3).tolist() for _ in range(9)]
    rows = list(enumerate(base))
    rows += [(500 + i, base[0]) for i in range(40)]                     # copies
    rows += [(600, None), (601, []), (602, [float("nan")] * 20), (603, [1.0, None, 2.0]), (604, [float("inf")] * 3),
             (605, [7.0, 7.0]), (None, base[1]), (5, base[2]), (606, [1e6, 2.0, 3.0])]
    return spark.createDataFrame([(i, v, "x", "n", "w", 1) for i, v in rows], VECS).repartition(3)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(vectors, weights):
    got = sorted(whitening.whiten(vectors, weights=weights).collect(), key=lambda r: repr((r["vec_id"], r["n"], r["deviation"])))
    want = plain_whitening([(r["vec_id"], r["embedding"]) for r in vectors.collect()], weights)
    assert [(r["vec_id"], r["n"], r["deviation"]) for r in got] == [w[:3] for w in want]
    signs = {}
    for r, (_, _, _, white, explained) in zip(got, want, strict=True):
        for k, (a, b) in enumerate(zip(r["white"], white, strict=True)):
            assert (a is None) == (b is None) and (a is None or abs(abs(a) - b) < 1e-7)
        assert r["explained"] == pytest.approx(explained, abs=1e-9) if explained[0] is not None else r["explained"][0] is None
        assert r["identity_error"] is None or r["identity_error"] < 1e-9
        signs.setdefault((len(r["white"]), r["n"]), []).append([v or 0.0 for v in r["white"]])
    for (d, n), rows in signs.items():      # one sign per component: distinct rows are uncorrelated
        y = np.array(sorted(set(map(tuple, rows)))) if weights == "one" else np.array(rows)
        if n > d:
            assert np.allclose(y.T @ y / n, np.diag([1.0] * y.shape[1]), atol=1e-7)


def test_whitening_keeps_large_sums_exact():
    dev = whitening._deviations(np.array([[1 << 52, 3]]), 1 << 20, [1 << 60, 5])
    assert dev.tolist() == [[(1 << 72) - (1 << 60), (3 << 20) - 5]]
    assert whitening._squares(dev) == [None]


def test_whitening_without_rows(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whitening.whitened_components(none).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(none, weights="half")


def test_op13_on_the_small_table(spark):
    got = queries.op13_embedding_whitening(spark, SF)
    rows = [(r["vec_id"], r["embedding"]) for r in common.table(spark, SF, "embeddings").collect()]
    want = {(i, k + 1): (n, dev, w[k], e[k]) for i, n, dev, w, e in plain_whitening(rows) for k in range(16)}
    got = {(r["vec_id"], r["component"]): r for r in got.collect()}
    assert got.keys() == want.keys()
    for key, (n, dev, white, explained) in want.items():
        r = got[key]
        assert (r["n"], r["deviation"]) == (n, dev) and abs(abs(r["whitened"]) - white) < 1e-8
        assert r["explained"] == pytest.approx(explained, rel=1e-9) and r["identity_error"] < 1e-9

"""The training-data operators against brute force on small tables that hold
nulls, empty and long texts, ties, repeated rows and clashing column names."""
import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ebb.llm import bpe, ctw, embed_dedup, exact_dedup, ngram_join, packing, queries, substring_dedup, token_files, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id string, h string, node string, size string"


def texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = " ".join(rnd.choice(words) for _ in range(300))
    changed = base.split()
    changed[150] = "other"
    long = " ".join(rnd.choice(words) for _ in range(20_000))
    out = [None, "", " \n\t", "one", "One", "two words", base, base, base.replace(" ", "\n"), " ".join(changed),
           "x " + base, long, "for " * 200, "Grüße 日本語 it's\x85 <|endoftext|> 12³", "you are not an idiot",
           " ".join(rnd.choice(words) for _ in range(90)), " ".join(changed[100:200])]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*texts(), (6, texts()[6][1]), (None, "one"), (None, None)]  # a repeated row and null ids
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def norm(t):
    return "".join(c for c in t if c not in " \t\n\x0b\x0c\r")


@pytest.mark.parametrize("content_hash", [exact_dedup.md5_128, lambda c: F.substring(F.md5(c.cast("binary")), 1, 1)])
def test_exact_dedup(docs, empty, content_hash):
    got = exact_dedup.exact_dedup(docs, content_hash=content_hash).collect()
    src = rows_of(docs)
    big = (1 << 63) - 1
    by = {}
    for i, t in src:
        by.setdefault(norm(t), []).append((-len(t), big if i is None else i))
    want = Counter()
    for i, t in src:
        keep = min(by[norm(t)])[1]
        want[(i, None if keep == big else keep, len(by[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(by)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_token_files_and_packing(docs, empty):
    tok = Tokenizer.from_file(queries.BYTE_BPE)
    ids = {i: tok.encode(t, add_special_tokens=False).ids for i, t in texts_of(docs).items()}
    manifest = token_files.write_tokens(docs, queries.BYTE_BPE, end_id=0)
    got = token_files.read_tokens(docs.sparkSession, manifest).toPandas().sort_values("start")
    at = 0
    order = [None if pd.isna(d) else int(d) for d in got["doc_id"]]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    for r, d in zip(got.itertuples(), order, strict=True):
        assert r.start == at
        at += r.n_tokens
        if d is not None:
            want = np.array([*ids[d], 0], dtype="<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(want), zlib.crc32(want.tobytes()))
    assert token_files.read_tokens(docs.sparkSession, token_files.write_tokens(empty, queries.BYTE_BPE, 0)).count() == 0
    p = packing.pack(docs, queries.BYTE_BPE).toPandas()
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert (g["length"].cumsum() - g["length"]).tolist() == g["offset"].tolist() and g["length"].sum() <= 1024
    for d, g in p[~p.doc_id.duplicated(keep=False) | (p.doc_id == 11)].groupby("doc_id"):
        want, g = np.array([*ids[int(d)], 2], dtype="<u4"), g.sort_values("piece")
        assert g["length"].sum() == len(want) and (g["length"].iloc[1:] == 1024).all()
        assert [zlib.crc32(want[s:s + n].tobytes()) for s, n in zip(g["start"], g["length"], strict=True)] == g["ids_crc32"].tolist()
    assert packing.pack(empty, queries.BYTE_BPE).count() == 0


def test_token_files_of_shared_ids(spark):
    """Texts without an id, or of one id, are dealt over parts; both widths hold the same ids."""
    rows = [(None if i % 2 else 7, f"text number {i}", "a", "b", "c", "d") for i in range(400)]
    many = spark.createDataFrame(rows, DOCS)
    narrow, wide = (token_files.write_tokens(many, queries.BYTE_BPE, 0, wide=w) for w in (None, True))
    assert (narrow["dtype"], wide["dtype"]) == ("<u2", "<u4")
    assert max(p["docs"] for p in narrow["parts"]) < 200
    a, b = (token_files.read_tokens(spark, m).toPandas().sort_values("start") for m in (narrow, wide))
    assert a["doc_id"].isna().tolist() == [True] * 200 + [False] * 200
    assert a["ids_crc32"].tolist() == b["ids_crc32"].tolist() and a["start"].tolist() == b["start"].tolist()
    assert a["ids_crc32"].nunique() == 400


def texts_of(docs):
    return {i: t for i, t in rows_of(docs) if i is not None}


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(3)
    for _ in range(50):
        sizes = sorted((rnd.choice([1, 2, 3, 5, 7, 9, 13, 20, 32]) for _ in range(rnd.randint(0, 80))), reverse=True)
        rooms = []
        for s in sizes:
            fit = [i for i, r in enumerate(rooms) if r >= s]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= s
            else:
                rooms.append(32 - s)
        fill = Counter()
        for length, end, begin, per, first, at in packing.plan_bins(dict(Counter(sizes)), 32):
            for rank in range(begin, end):
                fill[first + (rank - begin) // per] += length
        assert sorted(32 - v for v in fill.values()) == sorted(rooms)


def test_url_rules_and_graph(spark):
    links = {"a.org": ["b.net"], "b.net": ["c.net"], "spam.net": ["www.example.org"], "c.net": []}
    pages = [(i, f"http://{h}/p", "".join(f'<a href="https://{t}/x">' for t in to), "clash") for i, (h, to) in enumerate(links.items())]
    pages += [(10, "http://WWW.example.org/es/1?x", None, "c"), (11, None, "", "c"), (12, "no scheme", "<a href='/r'>", "c"),
              (13, "https://x.com/fr/9#t", None, "c"), (14, "https://example.org/en/12", None, "c"), (14, "https://org", "", "c"),
              (15, "http://a.com?to=http://b.com/fr/1", None, "c"), (16, "http://A.com#x://y/z", None, "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = {(r["page_id"], r["host"]): (r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df).collect()}
    assert got[10, "www.example.org"] == ("/es/1", "example.org/es/", "block")
    assert got[11, ""] == got[12, ""] == ("", None, "allow")
    assert got[13, "x.com"] == ("/fr/9", "com/fr/", "allow")
    assert got[14, "example.org"] == ("/en/12", "example.org/en/1", "block")
    assert got[14, "org"] == ("", None, "allow")
    assert got[15, "a.com"] == got[16, "a.com"] == ("", None, "allow")  # a second :// is no host
    assert got[1, "b.net"][2] == got[3, "c.net"][2] == "allow" and got[2, "spam.net"][2] == "block"
    assert url_filter.url_filter(df.limit(0)).count() == 0
    # the flows against a plain power iteration
    edges, seeds = {("s", "t"): 2, ("s", "u"): 1, ("t", "s"): 1, ("u", "t"): 3}, {"s": 1.0, "v": 0.5}
    e = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    s = spark.createDataFrame(list(seeds.items()), "host string, weight double")
    now = dict(seeds)
    for _ in range(10):
        new = Counter({h: 0.15 * w for h, w in seeds.items()})
        for (a, b), n in edges.items():
            new[b] += 0.85 * now.get(a, 0) * n / sum(m for (c, _), m in edges.items() if c == a)
        now = dict(new)
    got = {r["host"]: r["score"] for r in url_filter.spread(e, s, "src", "dst", 10, 0.85).collect()}
    assert got.keys() == now.keys() and all(math.isclose(got[h], now[h]) for h in now)


def test_url_graph_far_and_faint(spark):
    chain = [f"h{i}.net" for i in range(14)] + ["www.example.org"]  # links of a long chain
    faint = ["a.net", "b.net", "c.net", "www.example.org"]          # small shares of links that come from elsewhere
    links = [(x, [y]) for way in (chain, faint) for x, y in zip(way, way[1:], strict=False)]
    links.append(("filler.net", [y for y in faint[1:] for _ in range(20_000)]))
    pages = [(i, f"http://{x}/p", "".join(f'<a href="//{y}/">' for y in to)) for i, (x, to) in enumerate(links)]
    pages += [(99, "http://www.example.org/es/1", None), (98, "http://lone.net/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["host"]: (r["verdict"], r["distrust"]) for r in url_filter.url_filter(df).collect()}
    assert got.pop("lone.net")[0] == "allow" and got.pop("www.example.org")[0] == "block"
    assert all(verdict == "block" and distrust > 0 for verdict, distrust in got.values()), got
    assert got["a.net"][1] < 1e-12


def test_toxicity(spark, docs, empty):
    g = toxicity.Grammar({"idiot": 4.0}, {"lowe": 3.0}, (-3.0, 1.0, 1.0))
    one = lambda t: sum(g.clauses(t))
    assert one("an idiot") == 4.0 and one("a idiotic tale") == 0 and one("loweisch") == 3.0
    assert one("you idiot") > one("an idiot") > one("not an idiot") and one("she said an idiot") < one("you idiot")
    assert one("they will kill you") > 0 == one("kill the process") and g.score("") < 0.5
    rows = [(i, ("the fine day number %d" % i) + (" scumbag" if i % 4 == 0 else "")) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] * 2, "doc_id long, toxic int")
    got = toxicity.toxicity(d, labels).toPandas()
    assert (got["predicted"] == (got["doc_id"] % 4 == 0)).all() and got["score"].between(0, 1).all()
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]
    assert toxicity.toxicity(docs, labels.limit(0)).count() == docs.count() and toxicity.toxicity(empty, labels).count() == 0
    real, lab = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = toxicity.toxicity(real, lab).where("held_out").join(lab, "doc_id").toPandas()
    assert (held["predicted"] == held["toxic"]).mean() > 0.95


def components(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return root


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_ngram_join(docs, empty, k, num):
    rows = rows_of(docs)
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = components(len(rows), lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]))
    want = Counter()
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        want[(d, len(sets[i]), None if d is None else min(ids))] += 1
    got = ngram_join.ngram_join(docs, k, num, 100).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert ngram_join.ngram_join(empty).count() == 0


def test_ngram_list_of_three_with_node_0():
    s = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 >> 8)
    sets = {5: s[:36], 7: s[1:38], 0: s[:40]}  # node 0 has the largest set
    lists = [(1, 5), (1, 7), (2, 5), (2, 7), (2, 0)]
    pdf = pd.DataFrame([(x, d, len(sets[d]), ngram_join.parity_sketch(sets[d]).tobytes()) for x, d in lists],
                       columns=["s", "node", "n", "sketch"])
    got = pd.concat(ngram_join.linked_lists(pdf, set(), set(), 80, 100))
    assert 0 in set(got["a"]) | set(got["b"])


def test_ngram_blocks_split(spark, monkeypatch):
    rnd = random.Random(1)
    base = [f"a{i}" for i in range(200)]
    rows = []
    for i in range(40):
        w = list(base)
        w[rnd.randrange(200)] = f"b{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "BLOCK", 1500)
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_lm_score(docs, empty):
    rows = rows_of(docs)
    words = [[*t.encode().lower().split(), b"\n"] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for own, h in zip(words, held, strict=True) if not h for w in own)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if d is None else d, h, len(w), sum(c[x] > 0 for x in w), n,
                   round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6))
                  for (d, _), w, h in zip(rows, words, held, strict=True))
    got = ctw.lm_score(docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got) and ctw.lm_score(empty).count() == 0


def test_context_tree_against_plain_recursion():
    text = b"abracadabra abra cadabra\n" * 3
    depth = 2
    counts = []
    for d in range(depth + 1):
        keys, n = np.unique(ctw.gram_keys([text], depth)[0] & np.uint64((1 << (8 * (d + 1))) - 1), return_counts=True)
        counts.append(ctw.node_counts(keys, n))
    tree, plain = ctw.ContextTree(counts), {}
    padded = b"\n" * depth + text
    for i in range(depth, len(padded)):
        for d in range(depth + 1):
            for k in range(8):
                node = (padded[i - d:i], 1 << k | padded[i] >> (8 - k))
                plain.setdefault(node, [0, 0])[padded[i] >> (7 - k) & 1] += 1
    kt = lambda a, b: math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(ctx, node):
        own = kt(*plain[ctx, node])
        if len(ctx) == depth:
            return own, own
        below = sum(weighted(c, node)[0] for c, m in plain if m == node and len(c) == len(ctx) + 1 and c[1:] == ctx)
        return np.logaddexp(own, below) - math.log(2), below

    def one(ctx, node, d):
        a, b = plain[ctx[len(ctx) - d:], node]
        p = (b + .5) / (a + b + 1)
        if d == depth or (ctx[len(ctx) - d - 1:], node) not in plain:
            return p
        own, below = kt(a, b), weighted(ctx[len(ctx) - d:], node)[1]
        share = 1 / (1 + math.exp(below - own))
        return share * p + (1 - share) * one(ctx, node, d + 1)

    want = 0.0
    for i in range(depth, len(padded)):
        for k in range(8):
            p = one(padded[i - depth:i], 1 << k | padded[i] >> (8 - k), 0)
            want += math.log10(p if padded[i] >> (7 - k) & 1 else 1 - p)
    assert math.isclose(ctw.Scorer(tree).texts([text])[0], want, rel_tol=1e-5)


@pytest.mark.parametrize("depth", [0, 2, 5])
def test_lm_score_keeps_every_context(docs, spark, monkeypatch, depth):
    rnd = random.Random(3)
    long = [" ".join("".join(rnd.choice("abcde") for _ in range(4)) for _ in range(9_000)) for _ in range(14)]
    many = spark.createDataFrame(list(enumerate(long, 100)), "doc_id long, text string")  # most contexts are rare
    many = many.unionByName(docs.select("doc_id", "text"))
    rows = [(d, ctw.normal(t.encode().lower().split())) for d, t in rows_of(many)]
    train = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    keys, n = np.unique(ctw.gram_keys(train, depth)[0], return_counts=True)
    scorer = ctw.Scorer(ctw.learn(keys, n, 0, depth))
    want = sorted((-1 if d is None else d, x) for (d, _), x in zip(rows, scorer.texts([t for _, t in rows]), strict=True))
    monkeypatch.setattr(ctw, "SUBTREES", 3_000)
    monkeypatch.setattr(ctw, "FAN", 2)  # units are split by block
    monkeypatch.setattr(ctw, "GRAMS", 20_000)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in ctw.lm_score(many, depth).collect())
    assert [d for d, _ in got] == [d for d, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-6)


@pytest.mark.parametrize("depth", [0, 2, 3, 6])
def test_gram_packing(depth):
    rnd = np.random.default_rng(4)
    keys = np.unique(rnd.integers(0, 1 << (8 * (depth + 1)), 500, dtype=np.uint64))
    turned = ctw.by_subtree(keys, depth)
    assert (ctw.from_subtree(turned, depth) == keys).all()
    assert (ctw.unpack_keys(ctw.pack_keys(np.sort(turned))) == np.sort(turned)).all()
    n = rnd.integers(0, 1 << 40, 9)
    assert (ctw.unpack(ctw.pack(n)) == n).all() and ctw.unpack(ctw.pack(np.zeros(3, np.int64))).tolist() == [0, 0, 0]


def test_bpe_round_trip(docs, empty):
    lib = Tokenizer.from_file(queries.WORD_BPE)
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, queries.WORD_BPE).collect()}
    for d, t in texts_of(docs).items():
        ids = lib.encode(t, add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == want, d
    assert bpe.round_trip(empty, queries.WORD_BPE).count() == 0
    one = bpe.word_bpe(queries.WORD_BPE)
    for word in ("a" * 3000, "thethein" * 300, "z" * 33):  # longer than the lookahead: emitted while reading
        assert list(one.encode(word)) == lib.encode(word, add_special_tokens=False).ids
    text = bpe.TextDecoder(one)
    assert "".join(map(text.feed, one.encode("Grüße 日本"))) + text.close() == "grüße 日本 "
    ids = list(one.encode("Grüße 日本, it's 12 o'clock <|endoftext|> naïve"))
    for cut in (0, 1, 3, len(ids)):  # however the ids are cut
        spelled = bpe.TextDecoder(one, spelled=True)
        got = spelled.feed_all(ids[:cut]) + "".join(map(spelled.feed, ids[cut:cut + 1])) + spelled.feed_all(ids[cut + 1:])
        assert got + spelled.close() == lib.decode(ids, skip_special_tokens=False)


def test_embedding_dedup(spark):
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((300, 16))
    x[100:140] = x[0] + 0.08 * rnd.standard_normal((40, 16))
    x[140:150] = x[3]
    x[150] = 2 * x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, [1.0]), (None, x[0].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("node", F.lit(2))
    good = [(i, np.array(v)) for i, v in rows if i is not None and i < 400]
    u = np.stack([v / np.linalg.norm(v) for _, v in good])
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    root = components(len(good), lambda i, j: hit[i, j])
    least = {r: min(good[j][0] for j in range(len(good)) if root[j] == r) for r in set(root)}
    want = Counter((good[i][0], int(hit[i].sum()), least[root[i]]) for i in range(len(good)))
    got = embed_dedup.embedding_dedup(df).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None and r["vec_id"] < 400) == want
    assert {(r["vec_id"], r["n_links"], r["kept"]) for r in got if r["vec_id"] is None or r["vec_id"] >= 400} == \
        {(i, 0, True) for i in (400, 401, 402, 403, 404, None)}
    assert embed_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embedding_dedup_of_several_lengths(spark, monkeypatch):
    """Vectors link within every length, whether it has codebooks of its own or not."""
    monkeypatch.setattr(embed_dedup, "LENGTHS", 2)
    rnd, rows = np.random.default_rng(5), []
    for d, n in ((16, 200), (12, 160), (3, 20), (1, 6)):  # two lengths with codebooks, two without
        x = rnd.standard_normal((n, d))
        x[n // 2:] = x[:n - n // 2] + 0.05 * rnd.standard_normal((n - n // 2, d))
        x[1] = x[0]
        rows += [v.tolist() for v in x]
    rnd.shuffle(rows)
    units = [np.array(v) / np.linalg.norm(v) for v in rows]
    same = lambda i, j: i != j and len(rows[i]) == len(rows[j]) and units[i] @ units[j] >= 0.95
    links = [sum(same(i, j) for j in range(len(rows))) for i in range(len(rows))]
    root = components(len(rows), same)
    least = {r: root.index(r) for r in set(root)}
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.embedding_dedup(df).collect()}
    assert got == {i: (links[i], least[root[i]], least[root[i]] == i) for i in range(len(rows))}


@pytest.mark.parametrize("window", [20, 50, 4])
def test_substring_dedup(docs, empty, window):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    seen, want = set(), {}
    for d, t in sorted(rows_of(unique)):
        w = t.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    got = substring_dedup.substring_dedup(unique, window).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want
    assert substring_dedup.substring_dedup(docs, window).count() == docs.count()
    assert substring_dedup.substring_dedup(empty).count() == 0
    texts = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(unique, window).collect()}
    for d, (_, n, sha) in want.items():
        assert hashlib.sha256(b" ".join((texts[d] or "").encode().split())).hexdigest() == sha
        assert n or texts[d] == dict(texts_or_none(unique))[d]


@pytest.mark.parametrize("window,shard", [(20, 10), (50, 4), (9, 1), (8, 1), (5, 1)])
def test_substring_large_shards(spark, monkeypatch, window, shard):
    """A passage in most documents with other words at its edges, near copies, repeated and null ids."""
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    rounds, deal = [], substring_dedup.deal_again
    monkeypatch.setattr(substring_dedup, "deal_again", lambda *a: rounds.append(a[2]) or deal(*a))
    rnd = random.Random(window)
    say = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    passage, other = say(70), say(90)
    rows = [(i, " ".join(say(rnd.randrange(12)) + passage[:rnd.randrange(55, 71)] + say(rnd.randrange(12)))) for i in range(60)]
    for i in range(25):                       # near copies: one word differs
        near = list(other)
        near[rnd.randrange(90)] = f"x{i}"
        rows.append((100 + i % 20, " ".join(near)))
    rows += [(None, " ".join(passage)), (None, " ".join(passage)), (None, " ".join(say(30) + other)), (7, rows[7][1]), (200, "a b " * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ranked = df.select("doc_id", "text", F.xxhash64("text").alias("alt")).collect()
    ranked.sort(key=lambda r: ((1 << 63) - 1 if r["doc_id"] is None else r["doc_id"], r["alt"]))
    seen, want = {}, []
    for r in ranked:
        w, place = r["text"].split(), (r["doc_id"], r["alt"])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            first = seen.setdefault(tuple(w[i:i + window]), (place, i))
            if first != (place, i):
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((r["doc_id"], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup.substring_dedup(df, window).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert rounds == substring_dedup.group_sizes(window)[:len(rounds)] and rounds


def texts_or_none(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_registered_queries_and_pipeline(spark):
    import corpus_pipeline

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = sorted(map(tuple, queries.op1_exact_dedup(spark, SF).collect()))
    assert got == sorted(con.execute(queries.ORACLE_SQL["op1_exact_dedup"]).fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            ids, before = {r[0] for r in out.select("doc_id").collect()}, {r[0] for r in docs.select("doc_id").collect()}
            assert ids <= before and len(ids) > 0.8 * len(before)
        docs = out
    assert docs.count() >= len(ids)


def test_deal_again_makes_one_row_per_run_of_copies(spark):
    """A copy of a segment is one row, and no segment makes more rows than it has groups, whatever the shard's size."""
    words = [f"w{i}" for i in range(32)]
    same = [(5, d, 1, 40, 52, " ".join(words).encode(), 72) for d in range(30)]
    own = [(5, 100 + d, 1, 40, 52, " ".join([f"x{d}", *words[1:]]).encode(), 72) for d in range(30)]
    segments = spark.createDataFrame(same + own, substring_dedup._SEGMENT).coalesce(1)
    rows = substring_dedup.deal_again(segments, 20, 3).collect()
    copies = {(r["oid"], r["begin"], r["stop"]) for r in rows if r["segment"] is None}
    assert {c for c in copies if c[0] < 100} == {(d, 40, 72) for d in range(1, 30)}
    assert sum(r["oid"] < 100 for r in rows) == 5 + 29
    assert {c for c in copies if c[0] >= 100} == {(100 + d, 41, 72) for d in range(30)}
    assert all(r["segment"].count(b" ") + 1 == r["stop"] - r["begin"] for r in rows if r["segment"] is not None)
    assert sum(r["oid"] >= 100 for r in rows) == 2 * 30


def test_edges_of_a_passage_are_not_dealt(spark, monkeypatch):
    """Words of a document's own around a passage are cut off; what is left are copies, so no shard stays large."""
    monkeypatch.setattr(substring_dedup, "SHARD", 100)
    dealt, deal = [], substring_dedup.deal_again
    monkeypatch.setattr(substring_dedup, "deal_again", lambda *a: dealt.append(a[2]) or deal(*a))
    own = lambda i, c: [f"é{c}{i}x{j}" for j in range(30)]
    passage = [f"ß{j}" for j in range(60)]
    rows = [(i, " ".join([*own(i, "a"), *passage, *own(i, "b")])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(df, 20).collect()}
    kept = lambda i, t: hashlib.sha256((t if i == 0 else " ".join(own(i, "a") + own(i, "b"))).encode()).hexdigest()
    assert got == {i: (60 if i else 0, kept(i, t)) for i, t in rows}
    assert not dealt


def test_shared_words_of_a_shard():
    """Against all pairs, with words that sort before a space, over several batches."""
    rnd = random.Random(3)
    runs = sorted((rnd.randrange(3), "".join(w + " " for w in rnd.choices(["a", "a\x01", "b", "\x01", "aé"], k=rnd.randrange(5))))
                  for _ in range(60))
    pdf = pd.DataFrame([(h, i, run) for i, (h, run) in enumerate(runs)], columns=["h", "i", "run"])
    got = [(h, i, n) for (h, i, _), n in substring_dedup.shared_words([pdf[:7], pdf[7:7], pdf[7:]], list(pdf))]
    first = lambda x, y: next((i for i, (a, b) in enumerate(zip(x.split(" "), y.split(" "))) if a != b), x.count(" "))  # noqa: E731, B905
    want = [(h, i, max([first(run, r) for j, (g, r) in enumerate(runs) if g == h and j != i], default=0)) for i, (h, run) in enumerate(runs)]
    assert got[1:-1] == want[1:-1]
    assert [got[0][2], got[-1][2]] == [runs[0][1].count(" "), runs[-1][1].count(" ")]
    assert substring_dedup.first_words("a b c ", 2) == "a b " and substring_dedup.first_words("", 0) == ""


def test_a_segment_at_the_same_place_is_no_copy():
    segments = [((1, 1), 0, b"a b c d"), ((1, 1), 0, b"a b c d"), ((2, 2), 5, b"a b c d")]
    assert list(substring_dedup.shard_spans(segments, 3)) == [((2, 2), 5, 9)]


def test_lm_look_ups():
    """Values come back in the order asked for; words are numbered as they come."""
    keys = np.array([3, 5, 9, 1 << 63], dtype=np.uint64)
    wanted = keys[[3, 0, 2, 2, 0, 1]]
    assert ctw.look_up(keys, np.array([.1, .2, .3, .4]), wanted).tolist() == [.4, .1, .3, .3, .1, .2]
    assert len(ctw.look_up(keys, np.zeros(4), wanted[:0])) == 0
    number = ctw.Numbers()
    assert number.of([b"x", b"y", b"\n"]).tolist() == [1, 2, 0] and number.of([b"y", b"z", b"x"]).tolist() == [2, 3, 1]

"""N-gram Jaccard join by T-occurrence search (DivideSkip), with the connected
components of its links.

A document's set are the hashes of its distinct k-word shingles. Two sets link
when their Jaccard similarity reaches ``num / den``; then each holds at least
T = ceil(num * n / den) shingles of the other. DivideSkip puts up to T - 1 of a
set's inverted lists aside as long ones, merges the others, and keeps what
occurs often enough in them for the long lists to fill up T.

Distributed form. (1) Equal sets are one class. A count sketch of fixed size
over all shingles fixes one order from rare to frequent. (2) With all T - 1
most frequent lists aside, a partner must occur in one of the n - T + 1 rarest
lists: only these short lists are built, by a shuffle on the shingle. Within a
list, pairs whose sizes or parity sketches (a lower bound of the symmetric
difference) exclude a link are dropped, and a spanning forest of the others is
kept, so a list of m documents sends less than m rows. (3) The forest's
components hold all possible links. Their documents meet in blocks of bounded
size; components above the bound are dealt out so that every two parts meet in
one block. In its block each document is a query of the full DivideSkip: merge
of short lists, binary probes of long ones, exact overlap. A pair that is
connected already is not verified again, so a group of copies costs no
quadratic output. (4) Components of the verified links are the result.

Sets are compared by 64-bit shingle hashes; a pair of sets of 1,000 shingles
is off by one with probability below 1e-13.

Edge cases: a null text, an empty one and one without words have an empty set
and link with nothing; fewer than k words make one shingle of the whole
sequence; a null id stands for itself with a null component; rows that repeat an
id are separate rows with the same id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, gram_hashes, hash_words, hot_join, mix, num_partitions, sorted_groups, text_of, words_of
from .components import connected_components

#: Counters of the frequency sketch, and slices in which tasks send theirs.
BUCKETS, SLICES = 1 << 18, 16
#: Shingles that meet in a block at most.
BLOCK = 2_000_000

def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = words_of(text, lower=True)
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hash_words(words)
    if len(h) < k:
        return mix(gram_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(gram_hashes(h, k))


def least_overlap(n, num: int, den: int):
    return -(-num * n // den)


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the set's hashes over 2^i >= n / 2 cells (256 at least), as
    64-bit words. Equal elements cancel, so the bits in which two sketches
    differ are at most the elements in which the sets differ."""
    bits = max(256, 1 << int(len(s) // 2).bit_length())
    ones = np.bincount((s >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view("<u8")


def fold(sketch: np.ndarray) -> np.ndarray:
    half = len(sketch) // 2
    return sketch[:half] ^ sketch[half:]


def bucket_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def forest_of_list(nodes: np.ndarray, n: np.ndarray, sketches: list[np.ndarray], num: int, den: int):
    """Spanning forest of the pairs of an inverted list that may link. The
    list is in ascending order of set sizes."""
    root = np.arange(len(nodes))
    out = []
    stacks: dict[int, tuple[list[int], np.ndarray]] = {}
    for i, sk in enumerate(sketches):
        low = least_overlap(int(n[i]), num, den)
        for size, own in ((len(sk), sk), (len(sk) // 2, fold(sk) if len(sk) > 4 else None)):
            if own is None or size not in stacks:
                continue
            at, rows = stacks[size]
            first = int(np.searchsorted(n[at], low))
            if first == len(at):
                continue
            js = np.asarray(at[first:])
            diff = np.bitwise_count(rows[first:len(at)] ^ own).sum(axis=1)
            # |A| + |B| - 2 overlap <= (|A| + |B|) (den - num) / (den + num)
            js = js[diff.astype(np.int64) * (den + num) <= (n[i] + n[js]) * (den - num)]
            for r in np.unique(root[js]):
                if r != root[i]:
                    out.append((nodes[i], nodes[r]))
                    root[root == r] = root[i]
        at, rows = stacks.get(len(sk), ([], np.empty((4, len(sk)), dtype="<u8")))
        if len(at) == len(rows):
            rows = np.concatenate([rows, np.empty_like(rows)])
        rows[len(at)] = sk
        at.append(i)
        stacks[len(sk)] = (at, rows)
    return out


def forest_of_short_list(nodes: list, n: list, sketches: list[bytes], num: int, den: int, pairs: set):
    """The same for a few documents, pair by pair; ``pairs`` holds those that
    another list has decided."""
    out, root = [], list(range(len(nodes)))
    bits = [(len(b) * 8, int.from_bytes(b, "little")) for b in sketches]
    for j in range(1, len(nodes)):
        low = least_overlap(n[j], num, den)
        for i in range(j - 1, -1, -1):
            if n[i] < low:
                break
            pair = (nodes[i], nodes[j])
            if root[i] == root[j] or pair in pairs:
                continue
            pairs.add(pair)
            (small, x), (large, y) = bits[i], bits[j]
            while large > small:
                large //= 2
                y = (y >> large) ^ (y & ((1 << large) - 1))
            if (x ^ y).bit_count() * (den + num) <= (n[i] + n[j]) * (den - num):
                out.append((nodes[i], nodes[j]))
                old = root[j]
                root = [root[i] if r == old else r for r in root]
    return out


def linked_lists(pdf: pd.DataFrame, lists: set, pairs: set, num: int, den: int):
    """Links of the inverted lists in ``pdf`` (sorted by s, n, node), without the
    lists and pairs that were met before."""
    if len(pdf):
        s, node, n, sketch = pdf["s"].to_numpy(), pdf["node"].tolist(), pdf["n"].tolist(), pdf["sketch"].tolist()
        cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
        edges = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j - i > 1:
                if len(lists) + len(pairs) > 1_000_000:
                    lists.clear()
                    pairs.clear()
                key = tuple(node[i:j])
                if key not in lists:
                    lists.add(key)
                    if j - i <= 32:
                        edges += forest_of_short_list(node[i:j], n[i:j], sketch[i:j], num, den, pairs)
                    else:
                        edges += forest_of_list(np.array(node[i:j]), np.array(n[i:j]),
                                                [np.frombuffer(b, dtype="<u8") for b in sketch[i:j]], num, den)
        if edges:
            yield pd.DataFrame(edges, columns=["a", "b"])


def divide_skip(nodes: np.ndarray, sets: list[np.ndarray], num: int, den: int):
    """Spanning forest of the exact links among the sets of a block."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    nodes, sets = nodes[order], [sets[i] for i in order]
    n = np.array([len(s) for s in sets], dtype=np.int64)
    m = len(sets)
    shingle = np.concatenate(sets)
    doc = np.repeat(np.arange(m), n)
    by = np.lexsort((doc, shingle))
    shingle, doc = shingle[by], doc[by]
    new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
    lists = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    posting = lists * m + doc            # sorted: a binary probe finds (list, document)
    where = np.empty(len(by), dtype=np.int64)
    where[by] = np.arange(len(by))       # a document's elements -> places in the postings
    ends = np.cumsum(n)
    root = np.arange(m)
    out = []
    for i in range(m):
        at = where[ends[i] - n[i]:ends[i]]
        own = lists[at]
        length = at - begin[own]         # documents before i in each list
        t = int(least_overlap(int(n[i]), num, den))
        keep = length > 0
        if keep.sum() < t:
            continue
        at, own, length = at[keep], own[keep], length[keep]
        rank = np.argsort(length, kind="stable")
        aside = min(t - 1, len(rank))
        # DivideSkip's rule: fewer lists aside when the longest is short anyway
        short, long = rank[:len(rank) - aside], rank[len(rank) - aside:]
        size = length[short]
        offset = np.repeat(begin[own[short]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        cand, count = np.unique(doc[offset], return_counts=True)
        fit = (n[cand] >= t) & (count >= t - aside)
        cand, count = cand[fit], count[fit]
        while True:
            open_ = root[cand] != root[i]
            cand, count = cand[open_], count[open_]
            if not len(cand):
                break
            _, one = np.unique(root[cand], return_index=True)  # one candidate of each component at a time
            y, have = cand[one], count[one]
            probe = (own[long][:, None] * m + y).ravel()
            spot = np.minimum(np.searchsorted(posting, probe), len(posting) - 1)
            overlap = have + (posting[spot] == probe).reshape(len(long), len(y)).sum(axis=0)
            linked = overlap * den >= num * (n[i] + n[y] - overlap)
            for j in y[linked]:
                if root[j] != root[i]:
                    out.append((nodes[i], nodes[j]))
                    root[root == root[j]] = root[i]
            stay = np.ones(len(cand), dtype=bool)
            stay[one] = False
            cand, count = cand[stay], count[stay]
    return out


def _frequency_sketch(found: DataFrame) -> np.ndarray:
    """Sum of the tasks' sketches: first in 64 groups per slice, then per slice."""
    def add(key, pdf):
        total = sum(np.frombuffer(b, dtype="<i8") for b in pdf["key"])
        return pd.DataFrame({"slice": [key[0]], "part": [0], "key": [total.tobytes()]})

    part = found.where("slice >= 0").select("slice", F.pmod("id", F.lit(64)).cast("int").alias("part"), "key")
    schema = "slice int, part int, key binary"
    part = part.groupBy("slice", "part").applyInPandas(add, schema)
    rows = part.groupBy("slice").applyInPandas(add, schema).collect()  # BUCKETS counters
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        own = np.frombuffer(r["key"], dtype="<i8")
        out[r["slice"] * len(own):(r["slice"] + 1) * len(own)] = own
    return out


def ngram_join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row."""
    spark = docs.sparkSession
    parts = num_partitions(docs)
    src = docs.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # ids travel with a flag, so that pandas keeps 64-bit integers
    flagged = src.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("null_id"), "text")

    def describe(batches):
        from pyspark import TaskContext

        seen = np.zeros(BUCKETS, dtype=np.int64)
        for pdf in batches:
            sets = [shingle_set(t, k) for t in pdf["text"]]
            if sets:
                seen += np.bincount(bucket_of(np.concatenate(sets)), minlength=BUCKETS)
            yield pd.DataFrame({"slice": -1, "id": pdf["id"], "null_id": pdf["null_id"], "n": [len(s) for s in sets],
                                "key": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]})
        for i, own in enumerate(np.split(seen, SLICES)):
            yield pd.DataFrame({"slice": [i], "id": [TaskContext.get().partitionId()], "null_id": [False], "n": [0],
                                "key": [own.astype("<i8").tobytes()]})

    found = cut_lineage(flagged.mapInPandas(describe, "slice int, id long, null_id boolean, n long, key binary"), "op6-sets")
    light = found.where("slice < 0").select(F.when(~F.col("null_id"), F.col("id")).alias("id"), "n", "key")
    frequency = spark.sparkContext.broadcast(_frequency_sketch(found))
    classes = (light.where("key is not null").groupBy("key")
               .agg(F.min("id").alias("least"), F.count("*").alias("size"), F.max("n").alias("n")))
    # node numbers ascend with the smallest id of a class
    classes = cut_lineage(classes.orderBy("least").withColumn("node", F.monotonically_increasing_id()), "op6-classes")
    single = classes.where("least is not null")

    def prefixes(batches):
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                s = shingle_set(text, k)
                if len(s):
                    rare = np.lexsort((s, frequency.value[bucket_of(s)]))
                    short = s[rare[:len(s) - least_overlap(len(s), num, den) + 1]]
                    rows.append((doc, hashlib.md5(s.tobytes()).digest(), parity_sketch(s).tobytes(), short.view(np.int64)))
            yield pd.DataFrame(rows, columns=["id", "key", "sketch", "short"])

    known = flagged.where("not null_id").select("id", "text")
    heads = known.mapInPandas(prefixes, "id long, key binary, sketch binary, short array<long>")
    heads = (heads.join(single.select(F.col("least").alias("id"), "key", "node", "n"), ["id", "key"])
             .dropDuplicates(["node"]))
    heads = cut_lineage(heads.select("node", "n", "sketch", "short"), "op6-heads")

    def repeated(batches):
        """Postings of the lists that hold two documents or more."""
        last, held = None, None  # the last posting so far; not yet sent if it is alone in its list
        for pdf in batches:
            if not len(pdf):
                continue
            s = pdf["s"].to_numpy()
            before = np.concatenate([[last is not None and s[0] == last], s[1:] == s[:-1]])
            many = before | np.concatenate([s[1:] == s[:-1], [False]])
            if held is not None and before[0]:
                yield held
            yield pdf[many]
            last, held = s[-1], None if many[-1] else pdf.iloc[-1:]

    postings = (heads.select("node", F.explode("short").alias("s")).repartition(parts, "s")
                .sortWithinPartitions("s").mapInPandas(repeated, "s long, node long"))
    postings = cut_lineage(postings.select("s", "node"), "op6-postings")

    def forests(batches):
        lists, pairs = set(), set()  # met before: near copies share many lists
        tail = None
        for pdf in batches:
            pdf = pdf if tail is None else pd.concat([tail, pdf])
            if not len(pdf):
                continue
            s = pdf["s"].to_numpy()
            end = int(np.searchsorted(s, s[-1]))  # the last list may go on in the next batch
            tail = pdf.iloc[end:]
            yield from linked_lists(pdf.iloc[:end], lists, pairs, num, den)
        if tail is not None:
            yield from linked_lists(tail, lists, pairs, num, den)

    maybe = (postings.join(heads.select("node", "n", "sketch"), "node").repartition(parts, "s")
             .sortWithinPartitions("s", "n", "node").mapInPandas(forests, "a long, b long"))
    group = connected_components(maybe)
    group = cut_lineage(group.join(single.select("node", "least", "key", "n"), "node"), "op6-groups")
    volume = group.groupBy("component").agg(F.sum("n").alias("volume"))
    total = volume.agg(F.sum("volume")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    volume = volume.withColumn("chunks", F.ceil(F.col("volume") / (BLOCK // 2)))
    mine = F.pmod(F.xxhash64("node"), F.col("chunks"))
    place = F.when(F.col("chunks") == 1, F.array(F.struct(
        F.lit(-1).cast("long").alias("g"), F.pmod(F.xxhash64("component"), F.lit(blocks)).alias("i"),
        F.lit(0).cast("long").alias("j")))).otherwise(F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1),
            lambda o: F.struct(F.col("component").alias("g"), F.least(o, F.col("mine")).alias("i"),
                               F.greatest(o, F.col("mine")).alias("j"))))
    placed = (group.join(volume, "component").withColumn("mine", mine).withColumn("places", place)
              .select(F.col("least").alias("id"), "key", "node", "places"))

    def gather(batches):
        for pdf in batches:
            sets = [shingle_set(t, k).tobytes() for t in pdf["text"]]
            own = [hashlib.md5(b).digest() == key for b, key in zip(sets, pdf["key"], strict=True)]
            yield pdf.assign(members=sets)[["node", "places", "members"]][np.array(own, dtype=bool)]

    schema = "node long, places array<struct<g:long,i:long,j:long>>, members binary"
    # a shuffle at every size: the documents that may link grow with the data
    met = (known.join(placed.hint("merge"), "id").mapInPandas(gather, schema)
           .select("node", "members", F.explode("places").alias("p")).select("node", "members", "p.g", "p.i", "p.j")
           .repartition(parts, "g", "i", "j").sortWithinPartitions("g", "i", "j"))

    def verify(batches):
        for _, g in sorted_groups(batches, ["g", "i", "j"]):
            g = g.drop_duplicates("node")
            edges = divide_skip(g["node"].to_numpy(), [np.frombuffer(b, dtype=np.uint64) for b in g["members"]], num, den)
            if edges:
                yield pd.DataFrame(edges, columns=["a", "b"])

    comps = connected_components(met.mapInPandas(verify, "a long, b long"))
    root = comps.where("node <> component").groupBy("component").agg(F.count("*").alias("members"))
    named = root.join(classes.select(F.col("node").alias("component"), F.col("least").alias("component_id")), "component")
    rows = light.count()
    linked = hot_join(comps, named, "component", "members", rows).select("node", "component_id")
    result = (classes.join(linked, "node", "left")
              .select("key", "size", F.coalesce("component_id", "least").alias("component_id")))
    full = hot_join(light.where("key is not null"), result, "key", "size", rows)
    full = full.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                       F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    return full.unionByName(light.where("key is null").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))

"""LM scoring by context-tree weighting over bytes, beside a unigram base.

Model. The text (words lower-cased A-Z, joined by one space, closed by an end
byte) is coded byte by byte; a byte is eight binary decisions, and each decision
has a Krichevsky-Trofimov estimate in every context of 0 to ``depth`` preceding
bytes. Context-tree weighting mixes the estimates of all depths: a node's
weighted probability is the mean of its own estimate and the product of its
children's, so its share Pe / (Pe + Pc) says how far the mixture should trust
the short context, and the prediction of a bit runs from the deepest known
context up. Scores are log10 probabilities of texts; ``bits_per_byte`` gives the
code length per byte.

Corpus work. (1) One scan deals the texts into blocks and writes each block's
texts, words and (depth + 1)-grams, a gram once per block with its count in the
block's training texts. Grams are dealt into PARTS by the last TOP bytes of
their context, so that a part holds whole subtrees of the context tree; a block
writes one packed row per part. (2) The rows are shuffled by unit (some parts
on end), summed, and each unit's subtrees are learnt; a task writes the unit's
distinct grams, packed, and the sums of its subtrees' weights for the shorter
contexts. No node is left out at any depth. (3) The nodes of contexts shorter
than TOP bytes finish the tree. Their number is bounded by the alphabet: at most
2^16 contexts of 255 nodes, and in UTF-8 text far fewer. (4) A unit's distinct
grams and the blocks' rows of it meet again, the unit is learnt once more, now
with the shorter contexts, and each row returns to its block with four bytes per
gram. Exact corpus counts return by word, and both are summed per text. Units
with the rows of many blocks are split by block, for sums as for scores. Each
text is shuffled once, to its block; neither the whole tree nor a list of words
or grams is broadcast.

Edge cases: a null or empty text is its end alone; a null id belongs to the
training part; rows that repeat an id are scored and counted each; without
training texts every bit has probability 1/2; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, crc32_mod, cut_lineage, mix, num_partitions, release, text_of, words_of

#: Context bytes from which on the tree is learnt in subtrees.
TOP = 3
#: Bytes that a task looks at together; words and grams of a block's dictionaries.
TOGETHER, DICTIONARY, GRAMS = 2 << 20, 400_000, 2_000_000
#: Parts into which each block deals its grams by subtree.
PARTS = 1024
#: Grams, counted once per block, from which on parts are units of their own.
SUBTREES = 100_000
#: Blocks whose rows of one unit a task reads.
FAN = 4096
_SLOTS = 21
END = b"\n"


class Numbers(dict):
    """Numbers words in the order in which they are first asked for; the end is 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of keys that are all among the ascending ``keys``. Searched in
    ascending order, neighbours take the same way through the keys."""
    by = np.argsort(wanted)
    out = np.empty(len(wanted), dtype=values.dtype)
    out[by] = values[np.searchsorted(keys, wanted[by])]
    return out


def normal(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def gram_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ends): for every byte its key, the ``depth`` bytes before it and
    itself, with end bytes before a text's begin; ends bounds the texts."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    pad = END * depth
    b = np.frombuffer(pad + pad.join(texts) if depth else b"".join(texts), dtype=np.uint8)
    key = np.zeros(len(b) - depth, dtype=np.uint64)
    for i in range(depth + 1):
        key = (key << np.uint64(8)) | b[i:len(b) - depth + i]
    keep = np.ones(len(key), dtype=bool)
    ends = np.cumsum(size)
    if depth:
        gaps = (ends[:-1] + depth * np.arange(len(size) - 1))[:, None] + np.arange(depth)
        keep[gaps.ravel()] = False
    return key[keep], ends


def by_subtree(keys: np.ndarray, depth: int) -> np.ndarray:
    """Gram keys with the last TOP context bytes in front: those of a subtree are neighbours in order."""
    first = min(TOP, depth)
    sub = (keys >> np.uint64(8)) & np.uint64((1 << (8 * first)) - 1)
    high = keys >> np.uint64(8 * (first + 1))
    return (sub << np.uint64(8 * (depth - first + 1))) | (high << np.uint64(8)) | (keys & np.uint64(255))


def from_subtree(keys: np.ndarray, depth: int) -> np.ndarray:
    """The inverse of ``by_subtree``."""
    first = min(TOP, depth)
    sub = keys >> np.uint64(8 * (depth - first + 1))
    high = (keys >> np.uint64(8)) & np.uint64((1 << (8 * (depth - first))) - 1)
    return (high << np.uint64(8 * (first + 1))) | (sub << np.uint64(8)) | (keys & np.uint64(255))


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, as many as the largest needs: the upper ones compress well."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :data[0]] = planes.T
    return out.view("<u8").ravel()


def pack_keys(ordered: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return pack(np.diff(ordered, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8."""
    x = np.asarray(x, dtype=np.float64)
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def node_counts(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted node keys (the context's bytes, then the node in the byte's bit
    tree) of grams, with the zeros and ones coded at each."""
    keys = keys.astype(np.uint64)
    byte = keys & np.uint64(255)
    nodes = np.concatenate([(keys & ~np.uint64(255)) | np.uint64(1 << k) | (byte >> np.uint64(8 - k)) for k in range(8)])
    ones = np.concatenate([n * ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64) for k in range(8)])
    found, at = np.unique(nodes, return_inverse=True)
    b = np.bincount(at, ones, minlength=len(found)).astype(np.int64)
    return found, np.bincount(at, np.tile(n, 8), minlength=len(found)).astype(np.int64) - b, b


class ContextTree:
    """Per depth: sorted node keys (context, node of the byte's bit tree), the
    estimate of a one and the share of the node's own estimate. A part of a tree
    holds the depths from ``first`` on; ``below`` then has the nodes under its
    last depth."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], first: int = 0, below=None):
        """``counts[i]``: sorted keys of the nodes with ``first + i`` context bytes,
        and how many zeros and ones were coded there. ``below``: keys, zeros,
        ones and log weighted probabilities of the children of the last depth."""
        self.depth = first + len(counts) - 1
        self.first = first
        self.nodes = [None] * len(counts)
        for d in range(self.depth, first - 1, -1):
            keys, a, b = counts[d - first]
            own = log_kt(a, b)
            if below is None:
                share, weighted = np.ones(len(keys)), own
            else:
                c_keys, c_a, c_b, c_weighted = below
                # a child's key without its oldest byte is its parent's
                parent = (c_keys & np.uint64((1 << (8 * (d + 1))) - 1))
                at = np.minimum(np.searchsorted(keys, parent), max(len(keys) - 1, 0))
                ok = keys[at] == parent if len(keys) else np.zeros(len(parent), dtype=bool)
                at = at[ok]
                sums = [np.bincount(at, v[ok], minlength=len(keys)) for v in (c_a, c_b, c_weighted)]
                rest = log_kt(np.maximum(a - sums[0], 0), np.maximum(b - sums[1], 0))
                children = sums[2] + rest
                share = 1 / (1 + np.exp(np.clip(children - own, -700, 700)))
                weighted = np.logaddexp(own, children) - math.log(2)
            self.nodes[d - first] = (keys, (b + 0.5) / (a + b + 1.0), share)
            below = (keys, a, b, weighted)
        self.below = below

    def bits(self, keys: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Probability of each of the eight bits of each key's last byte in its
        context, NaN where no depth knows the node; ``below`` has the same from
        the depths under this part."""
        byte = keys & np.uint64(255)
        out = np.full((len(keys), 8), np.nan)
        for k in range(8):
            node = np.uint64(1 << k) | (byte >> np.uint64(8 - k))
            one = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
            path = []
            known = np.ones(len(keys), dtype=bool)
            for d, (node_keys, p, share) in enumerate(self.nodes, self.first):
                if not len(node_keys):
                    break
                want = (((keys >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | node
                at = np.minimum(np.searchsorted(node_keys, want), len(node_keys) - 1)
                known = known & (node_keys[at] == want)
                if not known.any():
                    break
                path.append((known, np.where(one, p[at], 1 - p[at]), share[at]))
            prob = np.full(len(keys), np.nan) if below is None else below[:, k]
            for known, p, share in reversed(path):
                mixed = np.where(np.isnan(prob), p, share * p + (1 - share) * prob)
                prob = np.where(known, mixed, prob)
            out[:, k] = prob
        return out

    def log10(self, keys: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of the last byte of each key in its context."""
        prob = self.bits(keys, below)
        return np.log10(np.where(np.isnan(prob), 0.5, prob)).sum(axis=1)


class Scorer:
    """log10 probabilities of texts from a whole tree in memory (small corpora); a
    direct-mapped cache of a fixed number of grams spares the tree for frequent ones."""

    def __init__(self, tree: ContextTree):
        self.tree = tree
        self.keys = np.full(1 << _SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << _SLOTS)

    def bytes(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            value = self.tree.log10(new)
            out[miss] = value[back]
            self.keys[slot[miss]] = keys[miss]
            self.values[slot[miss]] = out[miss]
        return out

    def texts(self, texts: list[bytes]) -> np.ndarray:
        keys, ends = gram_keys(texts, self.tree.depth)
        return np.add.reduceat(self.bytes(keys), np.concatenate([[0], ends[:-1]])) if len(ends) else np.empty(0)


def bits_per_byte(log10_score: float, n_bytes: int) -> float:
    """Code length per byte."""
    return -log10_score / math.log10(2) / max(n_bytes, 1)


def together(sized, most: int):
    """Lists of items whose sizes reach ``most``."""
    held, size = [], 0
    for item, n in sized:
        held.append(item)
        size += n
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their numbers."""
    keys = np.concatenate([k for k, _ in parts])
    n = np.concatenate([v for _, v in parts])
    by = np.argsort(keys, kind="stable")  # sorted runs
    keys, n = keys[by], n[by]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[new], np.add.reduceat(n, new) if len(new) else n


class GramSums:
    """Sorted distinct grams with the sums of their counts, added in any number of lists."""

    def __init__(self):
        self.known, self.new, self.fresh = (np.empty(0, np.uint64), np.empty(0, np.int64)), [], 0

    def put(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.new.append((keys, n))
        self.fresh += len(keys)
        if self.fresh > max(len(self.known[0]), 500_000):
            self.all()

    def add(self, texts: list[bytes], train: bool, depth: int) -> None:
        """The grams of texts; those of held-out texts count zero."""
        if texts:
            keys, n = np.unique(gram_keys(texts, depth)[0], return_counts=True)
            self.put(keys, n if train else np.zeros(len(keys), dtype=np.int64))

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        self.known, self.new, self.fresh = merged([self.known, *self.new]), [], 0
        return self.known


def learn(keys: np.ndarray, n: np.ndarray, first: int, depth: int) -> ContextTree:
    """The tree's part from ``first`` context bytes on, from distinct grams of
    whole subtrees with their counts."""
    counts, known = [], n > 0
    keys, n = keys[known], n[known]
    for d in range(depth, first - 1, -1):
        if d < depth:  # shorter contexts are sums of longer ones
            keys, n = merged([(keys & np.uint64((1 << (8 * (d + 1))) - 1), n)])
        counts.append(node_counts(keys, n))
    return ContextTree(counts[::-1], first)


def gram_scores(grams: DataFrame, depth: int, partitions: int) -> DataFrame:
    """(block, keys, scores): the log10 probability of the last byte of each
    gram, packed like ``grams``, which has block, part, keys (packed in the
    order of ``by_subtree``), counts (packed, in the training texts) and size."""
    import pyarrow as pa

    spark = grams.sparkSession
    first = min(TOP, depth)
    found = grams.groupBy("block").agg(F.sum("size").alias("size")).agg(F.count("*"), F.sum("size")).first()
    salts, units = -(-found[0] // FAN) or 1, min(PARTS, -(-(found[1] or 0) // SUBTREES) or 1)
    # neighbouring parts make a unit
    rows = (grams.withColumn("unit", F.expr(f"part * {units} div {PARTS}"))
            .withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts))))
    fields = pa.schema([("unit", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("node", pa.int64()),
                        ("a", pa.int64()), ("b", pa.int64()), ("weighted", pa.float64())])
    kinds = "unit long, keys binary, counts binary, node long, a long, b long, weighted double"

    def units_of(batches):
        """(unit, its sums) from rows sorted by unit."""
        unit, sums = None, None
        for batch in batches:
            for own, keys, n in zip(*(batch[c].to_pylist() for c in ("unit", "keys", "counts")), strict=True):
                if own != unit:
                    if sums is not None:
                        yield unit, sums
                    unit, sums = own, GramSums()
                sums.put(unpack_keys(keys), unpack(n).astype(np.int64))
        if sums is not None:
            yield unit, sums

    def packed(unit, sums, **nodes):
        size = len(nodes["node"]) if nodes else 0
        keys, n = sums.all()
        own = {"unit": unit, "keys": pack_keys(keys), "counts": pack(n)}
        return pa.record_batch([pa.array([own.get(f.name)] + [None] * size, f.type) if f.name not in nodes else
                                pa.concat_arrays([pa.nulls(1, f.type), pa.array(nodes[f.name], f.type)])
                                for f in fields], schema=fields)

    def add(batches):
        for unit, sums in units_of(batches):
            yield packed(unit, sums)

    def subtrees(batches):
        """A row per unit with its distinct grams, and a row per node at which its subtrees hang."""
        for unit, sums in units_of(batches):
            keys, n = sums.all()
            nodes = {}
            if first:
                below, a, b, weighted = learn(from_subtree(keys, depth), n, first, depth).below
                node, at = np.unique(below & np.uint64((1 << (8 * first)) - 1), return_inverse=True)
                a, b, weighted = (np.bincount(at, v, minlength=len(node)) for v in (a, b, weighted))
                nodes = {"node": node.view(np.int64), "a": a.astype(np.int64), "b": b.astype(np.int64),
                         "weighted": weighted}
            yield packed(unit, sums, **nodes)

    sums = rows.select("unit", "salt", "keys", "counts")
    if salts > 1:  # rows of many blocks are summed by salt first
        sums = (sums.repartition(partitions, "unit", "salt").sortWithinPartitions("unit")
                .mapInArrow(add, kinds).select("unit", "keys", "counts"))
    learnt = cut_lineage(sums.select("unit", "keys", "counts").repartition(partitions, "unit")
                         .sortWithinPartitions("unit").mapInArrow(subtrees, kinds), "op7-tree")
    del sums
    release(spark)
    # contexts of fewer than TOP bytes: as many as the alphabet has, at any size
    held = (learnt.where("node is not null").groupBy("node")
            .agg(*(F.sum(c).alias(c) for c in ("a", "b", "weighted"))).orderBy("node").toArrow())
    node, a, b, weighted = (held[c].to_numpy() for c in ("node", "a", "b", "weighted"))
    node, counts = node.view(np.uint64), []
    for d in range(first):
        key, at = np.unique(node & np.uint64((1 << (8 * (d + 1))) - 1), return_inverse=True)
        counts.append((key, *(np.bincount(at, v, minlength=len(key)).astype(np.int64) for v in (a, b))))
    top = spark.sparkContext.broadcast(ContextTree(counts, 0, (node, a, b, weighted)))

    def finish(batches):
        """A unit's distinct grams come first and are scored; the blocks' rows look theirs up."""
        known, scores = None, None
        for batch in batches:
            blocks, packs, found = [], [], []
            for block, keys, n in zip(*(batch[c].to_pylist() for c in ("block", "keys", "counts")), strict=True):
                own = unpack_keys(keys)
                if block < 0:
                    whole = from_subtree(own, depth)
                    tree = learn(whole, unpack(n).astype(np.int64), first, depth)
                    known, scores = own, top.value.log10(whole, tree.bits(whole)).astype("<f4")
                    continue
                blocks.append(block)
                packs.append(keys)
                found.append(scores[np.searchsorted(known, own)].tobytes())
            yield pa.record_batch({"block": pa.array(blocks, pa.int64()), "keys": pa.array(packs, pa.binary()),
                                   "scores": pa.array(found, pa.binary())})

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    distinct = learnt.where("keys is not null").select("unit", every.alias("salt"), F.lit(-1).cast("long").alias("block"),
                                                       "keys", "counts")
    own = rows.select("unit", "salt", "block", "keys", F.lit(None).cast("binary").alias("counts"))
    return (distinct.unionByName(own).repartition(partitions, "unit", "salt")
            .sortWithinPartitions("unit", "salt", "block")
            .mapInArrow(finish, "block long, keys binary, scores binary"))


def lm_score(docs: DataFrame, depth: int = 5, fold: int = 7, held: int = 2,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if not 0 <= depth <= 6:
        raise ValueError("depth must be 0 to 6: a gram is packed into a long")
    import pyarrow as pa

    src = docs.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    src = src.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("null_id"), "text",
                     F.coalesce(crc32_mod(F.col("id"), fold) == held, F.lit(False)).alias("held_out"))
    schema = ("block long, nth long, id long, null_id boolean, held_out boolean, text binary, word binary, "
              "number long, c long, part long, keys binary, counts binary, size long")
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def rows_of(size, /, **columns):
        return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type)
                                for f in fields], schema=fields)

    def index(batches):
        """A row per text, a row per word of the block with its count in the
        training texts, and a row per part with its grams likewise."""
        from pyspark import TaskContext

        task, block = TaskContext.get().partitionId(), 0
        number, train, grams, nth = Numbers(), np.zeros(1, dtype=np.int64), GramSums(), 0

        def dictionaries(block_id):
            keys, n = grams.all()
            if not len(keys):
                return  # no text: each has at least its end
            words = list(number)
            for i in range(0, len(words), 50_000):
                own = words[i:i + 50_000]
                yield rows_of(len(own), block=[block_id] * len(own), word=own, number=range(i, i + len(own)),
                              c=train[i:i + len(own)])
            first = min(TOP, depth)
            part = mix((keys >> np.uint64(8)) & np.uint64((1 << (8 * first)) - 1)) % np.uint64(PARTS)
            keys = by_subtree(keys, depth)
            order = np.lexsort((keys, part))
            keys, n, part = keys[order], n[order], part[order].astype(np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = [*cuts[1:].tolist(), len(part)]
            bounds = list(zip(cuts.tolist(), ends, strict=True))
            yield rows_of(len(cuts), block=[block_id] * len(cuts), part=part[cuts], size=np.array(ends) - cuts,
                          keys=[pack_keys(keys[i:j]) for i, j in bounds], counts=[pack(n[i:j]) for i, j in bounds])

        rows = ((r, len(r[2]) + 100) for batch in batches
                for r in zip(*(batch[c].to_pylist() for c in ("id", "null_id", "text", "held_out")), strict=True))
        for group in together(rows, TOGETHER // 2):
            block_id = task << 24 | block
            texts, counted = [], [np.empty(0, dtype=np.int64)]
            for _, _, text, held_out in group:
                own = words_of(text, lower=True)
                texts.append(normal(own))
                own.append(END)
                ids = number.of(own)
                if not held_out:
                    counted.append(ids)
            more = np.bincount(np.concatenate(counted), minlength=len(number))
            more[:len(train)] += train
            train = more
            for part in (True, False):
                grams.add([t for t, r in zip(texts, group, strict=True) if r[3] != part], part, depth)
            yield rows_of(len(group), block=[block_id] * len(group), nth=range(nth, nth + len(group)),
                          id=[r[0] for r in group], null_id=[r[1] for r in group], held_out=[r[3] for r in group], text=texts)
            nth += len(group)
            if len(number) > DICTIONARY or len(grams.known[0]) > GRAMS:
                yield from dictionaries(block_id)
                number, train, grams, nth, block = Numbers(), np.zeros(1, dtype=np.int64), GramSums(), 0, block + 1
        yield from dictionaries(task << 24 | block)

    found = cut_lineage(src.mapInArrow(index, schema), "op7-index")
    by_word = Window.partitionBy("word")
    words = (found.where("word is not null").select("block", "word", "number", "c")
             .withColumn("total", F.sum("c").over(by_word))
             .withColumn("first", F.row_number().over(by_word.orderBy("block")) == 1))
    words = cut_lineage(words.select("block", "number", F.col("total").alias("c"), "first"), "op7-words")
    release(docs.sparkSession)
    sums = (words.where("first").agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first())
    n_train, distinct = int(sums[0] or 0), int(sums[1] or 0)
    whole_sum = n_train + distinct + 1
    parts = num_partitions(docs)
    scores = gram_scores(found.where("keys is not null").select("block", "part", "keys", "counts", "size"), depth, parts)
    none = F.lit(None)
    # a row per word has number and c, a row per part has keys and scores
    own = (words.select("block", "number", "c", none.cast("binary").alias("keys"), none.cast("binary").alias("scores"))
           .unionByName(scores.select("block", none.cast("long").alias("number"), none.cast("long").alias("c"),
                                      "keys", "scores")))

    def score(texts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        gram = own["keys"].notna().to_numpy()
        keys = from_subtree(np.concatenate([unpack_keys(k) for k in own["keys"][gram]]), depth)
        logs10 = np.frombuffer(b"".join(own["scores"][gram]), dtype="<f4")
        by = np.argsort(keys)
        keys, logs10 = keys[by], logs10[by].astype(np.float64)
        ids, n = own["number"].to_numpy()[~gram].astype(np.int64), own["c"].to_numpy()[~gram]
        c = np.zeros(len(ids))
        c[ids] = n
        del own
        logs, known = np.log10((c + 1) / whole_sum), c > 0
        texts = texts.sort_values("nth")  # words get their numbers in this order
        number, n_tokens, n_known, base, total = Numbers(), [], [], [], []
        for group in together(((t, len(t)) for t in texts["text"]), TOGETHER // 2):
            for t in group:
                own = t.split()
                own.append(END)
                i = number.of(own)
                n_tokens.append(len(i))
                n_known.append(int(known[i].sum()))
                base.append(float(logs[i].sum()))
            found, ends = gram_keys(group, depth)
            total.append(np.add.reduceat(look_up(keys, logs10, found), np.concatenate([[0], ends[:-1]])))
        return texts[["id", "null_id", "held_out"]].assign(
            score=np.concatenate(total) if total else [], n_tokens=n_tokens, n_known=n_known, base_score=base)

    texts = found.where("text is not null").select("block", "nth", "id", "null_id", "held_out", "text")
    scored = (texts.repartition(parts, "block").groupBy("block")
              .cogroup(own.repartition(parts, "block").groupBy("block"))
              .applyInPandas(score, "id long, null_id boolean, held_out boolean, score double, n_tokens long, "
                                    "n_known long, base_score double"))
    return scored.select(F.when(~F.col("null_id"), F.col("id")).alias("doc_id"), "held_out", "n_tokens", "n_known",
                         F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")

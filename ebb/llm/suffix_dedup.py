"""Suffix-array dedup: removes every byte that lies in a string of ``depth``
bytes which also starts anywhere else in the corpus, the same document included.

Method: difference-cover blockwise construction. A block of text is sorted one
suffix bucket at a time: splitters cut the suffixes by their first bytes, the
suffixes of a bucket are sorted by their first 13 bytes, and ties are resolved
by ranks that were computed before for the cover sample, the positions whose
remainder by 13 is in the perfect difference set {0, 1, 3, 9}. Any two suffixes
i, j have a shift d < 13 for which i + d and j + d are both in the sample, so one
comparison of two ranks decides a tie of any length. Memory is bounded by the
block, not by the length of the ties. Neighbours in the order that agree in
``depth`` bytes are repeats.

Which suffixes meet in a block. Sorting every suffix of a corpus in one order
would ship ``depth`` bytes for each. Here the suffixes are dealt out by a key of
their first ``depth`` bytes that neighbours share: the least hash of the grams
in these bytes. Consecutive suffixes with one key travel as a single segment of
text, and equal strings have equal keys, so they meet. Keys only deal: whether
strings are equal is decided by their bytes in the sorted block (segments that
are copies of each other as a whole are merged before, by key and 64-bit hash).

Plan. (1) A scan writes a light row per segment (place, key, hash). (2) Keys
that occur once leave; equal segments become classes by an aggregation with
map-side combine. All occurrences of a class of two or more are repeats. (3) Keys
with several classes are shards to sort; only these segments' text is read
again, from a table bucketed by row, so that no join moves texts. (4) A shard of
more than ``shard`` classes (a passage in very many documents, each with other
bytes at its edges) is dealt out again by finer keys: the suffixes are grouped
by the distance of the anchor gram from their start, in steps of 64, 8, then 1,
and the key is the text that all suffixes of such a group share. Those that hold a
document's own bytes there get keys that occur once and leave; those inside
the passage become equal segments. At step 1 the key is the whole string, so
every shard ends within its bound and is sorted in the same way. (5) Marks
return to their documents by row.

Edge cases: null texts count as empty; texts shorter than ``depth`` have no
string to repeat. Null and repeated ids are separate rows. Long texts are read in
pieces that overlap by ``depth`` - 1 bytes. An empty table gives no rows. Further
columns of the input are not read. A string of 64-bit keys that collide only
meets strangers in its block.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import col, cut_lineage, gram_hashes, hot_join, mix, num_partitions, release, text_of

GRAM = 32                 # bytes of a gram (at most half of the depth)
CHUNK = 1 << 20           # bytes of text hashed at once
LONGEST = 1024            # suffixes of a segment at most
SHARD = 4096              # segments of a shard at most
BLOCK_BYTES = 4 << 20     # text sorted at once; a shard is never split, so a block may exceed it by one shard
BUCKET = 1 << 18          # suffixes sorted at once
STEPS = (64, 8, 1)

# a perfect difference set: every nonzero remainder by 13 is the difference of exactly one pair
PERIOD, COVER = 13, (0, 1, 3, 9)
_SLOT = np.full(PERIOD, -1)
_SLOT[list(COVER)] = np.arange(len(COVER))
_SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
                    for b in range(PERIOD)] for a in range(PERIOD)])


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of uint64 keys."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    out = np.empty(len(keys), dtype=np.uint64)
    out[order] = np.cumsum(np.concatenate([[1], sorted_keys[1:] != sorted_keys[:-1]])).astype(np.uint64)
    return out


class CoverSample:
    """Ranks of the sample suffixes of a block by their first ``near`` and their
    first ``far`` bytes (13 times a power of two, ``near`` + 12 within the depth,
    ``far`` beyond it), by prefix doubling inside the sample."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n = len(text)
        padded = np.concatenate([text, np.zeros(2 * PERIOD + 8, dtype=np.uint8)])
        words = np.zeros(self.n + PERIOD, dtype=np.uint64)
        for k in range(8):
            words = (words << np.uint64(8)) | padded[k:k + len(words)]
        self.words = words                        # eight bytes from each position on
        at = (np.arange(-(-self.n // PERIOD))[:, None] * PERIOD + np.array(COVER)).ravel()
        at = np.minimum(at, self.n)               # past the end: padding
        rank = _ranks(self._prefix(at, _ranks(words[at])))
        length = PERIOD
        while True:
            if length + PERIOD - 1 <= depth:
                self.near, self.near_length = rank, length
            if length >= depth:
                break
            step = len(COVER) * (length // PERIOD)
            later = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), dtype=np.uint64)])
            rank = _ranks((rank << np.uint64(32)) | later)
            length *= 2
        self.far = rank

    def _prefix(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A key that orders 13 bytes from the rank of the first eight and the five after them."""
        return (first << np.uint64(40)) | (self.words[at + 5] & np.uint64((1 << 40) - 1))

    def prefix_order(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self._prefix(at, _ranks(self.words[at]))
        order = np.argsort(key)
        return at[order], key[order]

    def rank(self, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of sample positions; beyond the end there is nothing, rank 0."""
        index = at // PERIOD * len(COVER) + _SLOT[at % PERIOD]
        return np.where(index < len(ranks), ranks[np.minimum(index, len(ranks) - 1)], np.uint64(0))

    def equal(self, i: np.ndarray, j: np.ndarray, depth: int) -> np.ndarray:
        """Whether suffixes that agree in 13 bytes agree in ``depth``: two ranks
        that overlap, and the words at the end."""
        d = _SHIFT[i % PERIOD, j % PERIOD]
        second = (depth - PERIOD + 1 - self.near_length) // PERIOD * PERIOD
        out = self.rank(self.near, i + d) == self.rank(self.near, j + d)
        out &= self.rank(self.near, i + d + second) == self.rank(self.near, j + d + second)
        for k in (8, 16, 24):
            out &= self.words[i + depth - k] == self.words[j + depth - k]
        return out


def sort_bucket(cover: CoverSample, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes ``at`` in order, with the tie group of their first 13 bytes.
    Groups are split around a pivot each, all at once, by one rank comparison
    per suffix, until every group is a single suffix or equal throughout."""
    at, key = cover.prefix_order(at)
    tie = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    group, slots = tie.copy(), np.arange(len(at))
    while True:
        _, first, back, size = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
        live = (size > 1)[back]
        if not live.any():
            return at, tie
        slots, first, back = slots[live], (first + size // 2)[back][live], back[live]
        pivot = np.flatnonzero(live)              # places of live suffixes among the ones of this round
        now = at[slots]
        lookup = np.zeros(len(live), dtype=np.int64)
        lookup[pivot] = np.arange(len(pivot))
        other = now[lookup[first]]
        d = _SHIFT[now % PERIOD, other % PERIOD]
        mine, its = cover.rank(cover.far, now + d), cover.rank(cover.far, other + d)
        side = (mine > its).astype(np.int64) - (mine < its) + 1
        key = back * 3 + side
        order = np.argsort(key, kind="stable")
        at[slots] = now[order]
        key = key[order]
        keep = key % 3 != 1                       # the pivot's own class is done
        slots, group = slots[keep], key[keep]


def repeated(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Which of the suffixes at ``starts`` (each with ``depth`` bytes at least)
    share their first ``depth`` bytes with another of them."""
    cover = CoverSample(text, depth)
    out = np.zeros(len(text), dtype=bool)
    head = cover.words[starts]
    splitters = np.unique(np.sort(head[::64])[BUCKET // 64::BUCKET // 64])
    bucket = np.searchsorted(splitters, head, side="right")
    for b in range(len(splitters) + 1):
        own = starts[bucket == b]
        if len(own) < 2:
            continue
        at, tie = sort_bucket(cover, own)
        near = np.flatnonzero(tie[1:] == tie[:-1])
        same = near[cover.equal(at[near], at[near + 1], depth)]
        out[at[same]] = out[at[same + 1]] = True
    return out[starts]


def _hashes(body: np.ndarray) -> np.ndarray:
    return gram_hashes(mix(np.arange(1, 257, dtype=np.uint64))[body], GRAM)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values, from running minima of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _digest(parts: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return _signed(np.array([xxh3_64_intdigest(p) for p in parts], dtype=np.uint64))


def _chunks(bodies, depth: int):
    """Lists of (row, offset, bytes) of about CHUNK bytes; long texts in
    pieces that overlap by depth - 1."""
    held, size = [], 0
    for row, body in enumerate(bodies):
        if len(body) < depth:
            continue
        for a in range(0, len(body) - depth + 1, CHUNK):
            piece = body[a:a + CHUNK + depth - 1]
            if held and size + len(piece) > CHUNK:
                yield held
                held, size = [], 0
            held.append((row, a, piece))
            size += len(piece)
    if held:
        yield held


def find_segments(bodies, depth: int):
    """(row, start, n, anchors, key, hash) arrays of the segments of some texts:
    runs of suffixes with one key; ``anchors`` counts the places of the least gram."""
    places = np.uint64((1 << 22) - 1)             # more than a chunk has
    for held in _chunks(bodies, depth):
        joined = b"".join(p for _, _, p in held)
        text = np.frombuffer(joined, dtype=np.uint8)
        grams = _hashes(text)
        # the leftmost of equal grams is the anchor, so equal strings have theirs at the same distance
        least = (grams & ~places) | np.arange(len(grams), dtype=np.uint64)
        at = (_sliding_min(least, depth - GRAM + 1) & places).astype(np.int64)
        least = grams[at]
        sizes = np.array([len(p) for _, _, p in held])
        ends = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(held)), sizes)[:len(least)]
        valid = np.arange(len(least)) + depth <= ends[piece]
        cut = np.concatenate([[True], (least[1:] != least[:-1]) | (piece[1:] != piece[:-1]) | (valid[1:] != valid[:-1])])
        run = np.cumsum(cut) - 1
        since = np.arange(len(least)) - np.flatnonzero(cut)[run]
        cut |= since % LONGEST == 0               # the same gram over and over: cut the run
        starts = np.flatnonzero(cut)
        n = np.diff(np.append(starts, len(least)))
        moves = np.add.reduceat(np.concatenate([[0], at[1:] != at[:-1]]) * ~cut, starts)
        anchors = 1 + moves[valid[starts]]
        starts, n = starts[valid[starts]], n[valid[starts]]
        piece = piece[starts]
        offset = np.array([a for _, a, _ in held]) - (ends - sizes)
        yield (np.array([r for r, _, _ in held])[piece], starts + offset[piece], n, anchors, _signed(least[starts]),
               _digest([joined[a:a + k + depth - 1] for a, k in zip(starts.tolist(), n.tolist(), strict=True)]))


def refine(body: bytes, start: int, n: int, anchor: int, depth: int, step: int):
    """(start, n, key) of a segment's suffixes, grouped by the distance of their
    first anchor gram in ``step``s; the key is the text all of a group share."""
    from xxhash import xxh3_64_intdigest

    grams = _signed(_hashes(np.frombuffer(body, dtype=np.uint8, count=n + depth - 1, offset=start)))
    places = np.flatnonzero(grams == anchor)
    at = places[np.searchsorted(places, np.arange(n))]            # of each suffix's first anchor
    group = (at - np.arange(n)) // step
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (group[1:] != group[:-1])]))
    for a, b in zip(cut.tolist(), [*cut.tolist()[1:], n], strict=True):
        lo = start + int(at[a]) - int(group[a]) * step            # the last start such a group can have
        core = body[lo:lo + depth - step + 1]
        key = xxh3_64_intdigest(core + b"%d %d %d" % (anchor, group[a], step))
        yield start + a, b - a, key - (1 << 64) if key >> 63 else key


_SEGMENT = "uid long, start int, n int, anchors int, anchor long, key long, hash long, copies long"


def _store(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, body) bucketed by uid: later joins by row move no text."""
    spark, n, name = docs.sparkSession, num_partitions(docs), f"ebb_op11_{uuid.uuid4().hex}"
    src = docs.select(F.monotonically_increasing_id().alias("uid"), col(id_col).cast("long").alias("doc_id"),
                      text_of(text_col).cast("binary").alias("body"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ebb-tables/{name}"
    (src.repartition(n, "uid").write.bucketBy(n, "uid").option("path", path)
     .option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


def _with_text(texts: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """Texts of the rows in ``rows`` with the list ``items`` of their structs; a document bounds the list."""
    items = rows.groupBy("uid").agg(F.collect_list(F.struct(*fields)).alias("items"))
    return texts.join(items.hint("shuffle_hash"), "uid")


def _level(segments: DataFrame, name: str, shard: int) -> tuple[DataFrame, DataFrame]:
    """Repeats that whole equal segments show, and the classes of the keys with several of them."""
    keys = segments.groupBy("key").agg(F.sum("copies").alias("total"), F.max("anchors").alias("anchors"),
                                         F.count("*").alias("rows"))
    keys = cut_lineage(keys.where("total > 1 or anchors > 1").select("key", "rows"), f"{name}-keys")
    rows = keys.agg(F.sum("rows")).first()[0] or 0
    found = cut_lineage(hot_join(segments, keys, "key", "rows", max(rows, 1)).drop("rows"), f"{name}-recurring")
    classes = found.groupBy("key", "hash").agg(
        F.sum("copies").alias("copies"), F.max("anchors").alias("anchors"), F.count("*").alias("rows"),
        F.min(F.struct("uid", "start", "n", "anchor")).alias("rep"))
    classes = cut_lineage(classes.select("key", "hash", "copies", "anchors", "rows", "rep.*"), f"{name}-classes")
    many = (classes.where("copies > 1").select(F.struct("key", "hash").alias("class"), "rows"))
    marks = hot_join(found.select("uid", "start", "n", F.struct("key", "hash").alias("class")), many, "class", "rows",
                     max(rows, 1)).select("uid", "start", "n")
    # strings may recur between classes, or inside one that holds its anchor gram at several places
    shards = classes.groupBy("key").agg(F.count("*").alias("classes"), F.max("anchors").alias("most"))
    shards = cut_lineage(shards.where("classes > 1 or most > 1").select("key", "classes"), f"{name}-shards")
    mixed = hot_join(classes.drop("rows", "anchors"), shards, "key", "classes", max(rows, 1))
    mixed = cut_lineage(mixed.withColumn("large", F.col("classes") > shard), f"{name}-mixed")
    return marks, mixed


def _sort_shards(texts: DataFrame, classes: DataFrame, depth: int, parts: int) -> DataFrame:
    """(uid, start, n) of the repeats among the segments of shards."""
    def emit(batches):
        for pdf in batches:
            for uid, body, items in zip(pdf["uid"], pdf["body"], pdf["items"], strict=True):
                yield pd.DataFrame([(i["key"], uid, i["start"], i["n"], i["copies"],
                                     bytes(body[i["start"]:i["start"] + i["n"] + depth - 1])) for i in items],
                                   columns=["key", "uid", "start", "n", "copies", "seg"])

    def batched(frames):
        held, size = [], 0
        for f in emit(frames):
            held.append(f)
            size += len(f)
            if size >= 1000:
                yield pd.concat(held)
                held, size = [], 0
        if held:
            yield pd.concat(held)

    def solve(pdf):
        segs = pdf["seg"].to_list()
        sizes = np.array([len(s) for s in segs])
        n = pdf["n"].to_numpy().astype(np.int64)
        base = np.cumsum(sizes) - sizes
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(base, n) + nth
        hit = repeated(np.frombuffer(b"".join(segs), dtype=np.uint8), starts, depth)
        own = np.repeat(np.arange(len(n)), n)
        hit &= (pdf["copies"].to_numpy() == 1)[own]               # the others are marked as a class
        cut = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (own[1:] == own[:-1])]))
        end = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (own[1:] == own[:-1]), [False]]))
        seg = own[cut]
        return pd.DataFrame({"uid": pdf["uid"].to_numpy()[seg], "start": pdf["start"].to_numpy()[seg] + nth[cut],
                             "n": end - cut + 1})

    def search(batches):
        held, size = [], 0
        for pdf in batches:
            keys = pdf["key"].to_numpy()
            if held and size >= BLOCK_BYTES:
                # complete the shard that is open, then sort the block
                cut = len(keys) if keys[-1] == (last := held[-1]["key"].iloc[-1]) else int(np.argmax(keys != last))
                held.append(pdf.iloc[:cut])
                pdf = pdf.iloc[cut:]
                if not len(pdf):
                    continue
                yield solve(pd.concat(held, ignore_index=True))
                held, size = [], 0
            held.append(pdf)
            size += int(pdf["seg"].map(len).sum())
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    rows = _with_text(texts, classes, ["key", "start", "n", "copies"])
    sent = rows.mapInPandas(batched, "key long, uid long, start int, n int, copies long, seg binary")
    return sent.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(search, "uid long, start int, n int")


def repeated_ranges(texts: DataFrame, depth: int, shard: int) -> DataFrame:
    """(uid, start, n): suffixes start, start + 1, ... of text uid whose first ``depth`` bytes occur again."""
    spark, parts = texts.sparkSession, num_partitions(texts)

    def scan(batches):
        for pdf in batches:
            uid = pdf["uid"].to_numpy()
            for row, start, n, anchors, key, digest in find_segments(pdf["body"], depth):
                yield pd.DataFrame({"uid": uid[row], "start": start, "n": n, "anchors": anchors, "anchor": key, "key": key, "hash": digest,
                                    "copies": 1})

    segments = cut_lineage(texts.select("uid", "body").mapInPandas(scan, _SEGMENT), "op11-segments")
    marks = []
    for level, step in enumerate([*STEPS, None]):
        name = f"op11-{level}"
        whole, mixed = _level(segments, name, shard)
        marks.append(cut_lineage(whole, f"{name}-equal"))
        fields = ["uid", "start", "n", "anchor", "key", "copies"]
        small = mixed.where("not large").select(fields) if step else mixed.select(fields)
        marks.append(cut_lineage(_sort_shards(texts, small, depth, parts), f"{name}-sorted"))
        release(spark)
        large = mixed.where("large").select(fields)
        if step is None or large.isEmpty():
            break

        def deal(batches, step=step):
            for pdf in batches:
                for uid, body, items in zip(pdf["uid"], pdf["body"], pdf["items"], strict=True):
                    body, out = bytes(body), []
                    for i in items:
                        for start, n, key in refine(body, i["start"], i["n"], i["anchor"], depth, step):
                            out.append((uid, start, n, 1, i["anchor"], key, body[start:start + n + depth - 1],
                                        min(i["copies"], 2)))
                    f = pd.DataFrame(out, columns=["uid", "start", "n", "anchors", "anchor", "key", "hash", "copies"])
                    f["hash"] = _digest(f["hash"].to_list())
                    yield f

        segments = cut_lineage(_with_text(texts, large, ["start", "n", "anchor", "copies"]).mapInPandas(deal, _SEGMENT),
                               f"{name}-dealt")
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    return out


def suffix_dedup(docs: DataFrame, depth: int = 400, id_col: str = "doc_id", text_col: str = "text",
                 shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, kept (remaining bytes), spans (removed runs as start and
    end): one row per input row."""
    if depth < 2 * GRAM:
        raise ValueError(f"depth is at least {2 * GRAM}")
    texts = _store(docs, id_col, text_col)
    release(docs.sparkSession)
    ranges = repeated_ranges(texts, depth, shard)
    ranges = ranges.groupBy("uid").agg(F.collect_list(F.struct("start", "n")).alias("items"))
    rows = texts.join(ranges.hint("shuffle_hash"), "uid", "left")
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("missing"),
                       "body", "items")

    def cut(batches):
        for pdf in batches:
            kept, spans = [], []
            for body, items in zip(pdf["body"], pdf["items"], strict=True):
                body = bytes(body)
                if items is None or not len(items):
                    kept.append(body)
                    spans.append([])
                    continue
                edge = np.zeros(len(body) + 1, dtype=np.int32)
                np.add.at(edge, [i["start"] for i in items], 1)
                np.add.at(edge, [i["start"] + i["n"] - 1 + depth for i in items], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(np.frombuffer(body, dtype=np.uint8)[~gone].tobytes())
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"start": a, "end": b} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "missing": pdf["missing"],
                                "n_bytes": pdf["body"].map(len), "kept": kept, "spans": spans})

    out = rows.mapInPandas(cut, "doc_id long, missing boolean, n_bytes long, kept binary, "
                                "spans array<struct<start: int, end: int>>")
    return out.select(F.when(~F.col("missing"), F.col("doc_id")).alias("doc_id"), "n_bytes", "kept", "spans")


def suffix_dedup_digests(docs: DataFrame, depth: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of :func:`suffix_dedup`."""
    return suffix_dedup(docs, depth).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

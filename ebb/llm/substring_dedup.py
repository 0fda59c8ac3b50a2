"""Substring dedup: removes every word covered by a window of ``window`` words
whose word sequence starts earlier in the corpus (smaller id, or earlier in the
same document). Suffix automata of reference shards give the matching
statistics.

Which texts can repeat. Every window holds ``window - GRAM + 1`` word grams; the
one with the least hash is the window's anchor. Equal windows have equal
anchors, so a window can only repeat if its anchor's hash occurs twice. One
shuffle of anchors (about one word in seven) finds those; around each, the
segment of all windows with that anchor is cut out.

Reference shards. The segments around one anchor hash form a shard: every
repeat of a window lies in its anchor's shard. A task reads a shard's segments
in order of id and start and feeds them to the shard's suffix automaton word by
word: the longest suffix known already is the matching statistic, and the state
of the last ``window`` words knows where that window first ended. If that is
another place, the window starts earlier elsewhere and its words go. The
automaton holds distinct content only; a copy of a segment that the shard has
read repeats as a whole, and a shard with one content needs no automaton. Before the shuffle, each task resolves segments that are copies of one
it has met itself: all their windows start earlier. So of a passage that a
third of all documents share, a shard gets a few copies per task.

Large shards. At the edges of such a passage the segments hold words of each
document's own, so there are as many as documents. The segments of a shard of
more than SHARD are sorted by the words before the anchor, read backwards, and
then by those from the anchor on: what a segment shares with any other on that
side it shares with a neighbour. The words beyond are in no window that repeats
and are cut off, one row per segment at most. What is left of such a passage are
equal segments, of which each task sends the first.

Shards that are still larger are dealt out by a finer key: their windows are
grouped by the distance of the anchor from their start, and the key is the text
that all windows of such a group share. Equal windows have equal keys, so they
still meet in one automaton. Groups shrink until one holds a single distance and
the key is the whole window, so every automaton reads SHARD segments at most.

Edge cases: a null text has no words; texts shorter than the window lose
nothing; a null id counts as the largest; rows that repeat an id with different
texts are ordered by a hash of the text, and rows that repeat id and text are
the same document, each with the same result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, gram_hashes, hash_words, num_partitions, release, text_of, words_of

#: Words of an anchor.
GRAM = 8
LAST = (1 << 63) - 1
#: Anchors that a task looks at together.
TOGETHER = 1_000_000
#: Segments of a shard, at most, that one automaton reads.
SHARD = 2000
#: Segments that a task remembers to resolve copies of them at once.
MET = 500_000


def anchors(texts: list[list[bytes]], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(position, hash) of the anchors of all windows of each text: the leftmost
    gram with the least hash in each. The texts are hashed as one run of words;
    windows that cross from one text to the next are left out."""
    gram = min(GRAM, window)
    sizes = np.array([len(words) for words in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    run = [w for words in texts for w in words]
    if len(run) < window:
        return [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))] * len(texts)
    g = gram_hashes(hash_words(run), gram)
    span = window - gram + 1
    at, value, reach = np.arange(len(g)), g, 1
    while reach < span:
        step = min(reach, span - reach)
        right = value[step:] < value[:-step]
        at = np.where(right, at[step:], at[:-step])
        value = np.where(right, value[step:], value[:-step])
        reach += step
    at = at[np.arange(len(at)) + window <= np.repeat(ends, sizes)[:len(at)]]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    h = g[at].view(np.int64)
    return [(at[i:j] - start, h[i:j]) for i, j, start in
            zip(np.searchsorted(at, starts).tolist(), np.searchsorted(at, ends).tolist(), starts.tolist(), strict=True)]


def together(rows, words: int = 100_000):
    """Lists of (row, words of its last field) of about ``words`` words."""
    held, size = [], 0
    for row in rows:
        own = words_of(row[-1])
        held.append((row[:-1], own))
        size += len(own)
        if size > words:
            yield held
            held, size = [], 0
    if held:
        yield held


class SuffixAutomaton:
    """Suffix automaton of word sequences that are added one after another.
    Each state keeps where its strings first ended."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first: list = [None]

    def _state(self, length: int, following: dict, link: int, first) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state for the strings of q that end in p's strings and the word."""
        clone = self._state(self.length[p] + 1, self.next[q].copy(), self.link[q], self.first[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def read(self, last: int, word, place) -> tuple[int, int]:
        """Adds a word after state ``last``; returns the new state and the state
        of the longest suffix that was known before."""
        q = self.next[last].get(word)
        if q is not None:
            if self.length[q] != self.length[last] + 1:
                q = self._split(last, word, q)
            return q, q
        new, p = self._state(self.length[last] + 1, {}, 0, place), last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new, self.link[new]

    def add(self, words: list, doc, start: int, window: int):
        """Adds a sequence; yields the ends of its windows that were known from another place."""
        state = 0
        for i, word in enumerate(words):
            place = (doc, start + i)
            state, known = self.read(state, word, place)
            if i >= window - 1 and self.length[known] >= window and self.first_end(known, window) != place:
                yield start + i + 1

    def follow(self, words: list, doc, start: int, window: int):
        """The same without adding the sequence: matching statistics only."""
        state, size = 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            if size >= window and self.first_end(state, window) != (doc, start + i):
                yield start + i + 1

    def first_end(self, state: int, size: int):
        """Where the last ``size`` words of a state's strings first ended."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return self.first[state]


def shard_spans(segments: list[tuple], window: int):
    """(document, begin, end) of the words that windows of one shard remove;
    ``segments`` are (document key, first word's position, segment) in order.
    A segment that was read before repeats as a whole, unless it is the same
    place, which two anchors of a document may have left."""
    sam, known = SuffixAutomaton(), {}
    distinct = len({s for _, _, s in segments})
    for doc, start, segment in segments:
        if segment in known:
            if known[segment] != (doc, start):
                yield doc, start, start + segment.count(b" ") + 1
            continue
        known[segment] = doc, start
        if distinct == 1:
            continue  # nothing else to compare it with
        begin, end = -1, -1
        # the last new segment has no later one to serve: it only follows the automaton
        ends = (sam.follow if len(known) == distinct else sam.add)(segment.split(b" "), doc, start, window)
        for stop in ends:
            if stop - window > end:
                if end > begin:
                    yield doc, begin, end
                begin = stop - window
            end = stop
        if end > begin:
            yield doc, begin, end


def by_size(segments: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The segments of shards of at most SHARD, and those of the others."""
    large = cut_lineage(segments.groupBy("h").count().where(F.col("count") > SHARD).select("h"), "op10-large")
    if large.isEmpty():
        return segments, None
    return segments.join(large, "h", "left_anti"), segments.join(large, "h", "left_semi")


def group_sizes(window: int) -> list[int]:
    """Distances of the anchor that a finer key holds together, down to one."""
    out, n = [], window - min(GRAM, window) + 1
    while n > 1:
        n = -(-n // (6 if not out else 4))
        out.append(n)
    return out or [1]


def finer(words: list[bytes], begin: int, at: int, h: int, window: int, step: int):
    """(key, first word, end) of the windows of a segment that starts at word
    ``begin``, grouped by the distance of the anchor (word ``at``) in steps."""
    from xxhash import xxh64_intdigest

    last = begin + len(words) - window
    for g in range((at - last) // step, (at - begin) // step + 1):
        final = at - g * step                     # the latest start of such a window
        first = final - step + 1
        core = b" ".join(words[final - begin:first + window - begin])
        key = xxh64_intdigest(b"%d %d %d " % (h, g, step) + core)
        yield key - (1 << 64) if key >> 63 else key, max(first, begin), min(final, last) + window


_SEGMENT = "h long, oid long, alt long, begin long, at long, segment binary, stop long"
_COLUMNS = ["h", "oid", "alt", "begin", "at", "segment", "stop"]


class Met:
    """The first place of each segment a task has met; forgets when it holds too many."""

    def __init__(self):
        self.places: dict = {}

    def before(self, h: int, segment: bytes, place: tuple) -> bool:
        """Whether the same segment was met at an earlier place."""
        if len(self.places) > MET:
            self.places.clear()
        key = (h, hashlib.md5(segment).digest())
        known = self.places.get(key)
        if known is not None and known < place:
            return True
        self.places[key] = place
        return False


def deal_again(segments: DataFrame, window: int, step: int) -> DataFrame:
    """The segments of large shards under finer keys; a row without a segment is
    a run of words whose windows all start earlier."""
    def deal(batches):
        met = Met()
        for pdf in batches:
            out = []
            for h, oid, alt, begin, at, segment in zip(*(pdf[c] for c in _COLUMNS[:-1]), strict=True):
                words, lo, hi = segment.split(b" "), -1, -1  # words that copies remove, as one span as long as they touch
                for key, first, stop in finer(words, begin, at, h, window, step):
                    part = b" ".join(words[first - begin:stop - begin])
                    if not met.before(key, part, (oid, alt, first)):
                        out.append((key, oid, alt, first, at, part, stop))
                        continue
                    if stop < lo or hi < 0:
                        if hi > lo:
                            out.append((0, oid, alt, lo, at, None, hi))
                        hi = stop
                    lo = first  # the groups come from the last window to the first
                if hi > lo:
                    out.append((0, oid, alt, lo, at, None, hi))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return segments.select(_COLUMNS).mapInPandas(deal, _SEGMENT)


def common_words(x: str, y: str) -> int:
    """Words at the begin that two runs share; each word is closed by a space."""
    if x == y:
        return x.count(" ")
    n = 0
    for a, b in zip(x.split(" "), y.split(" "), strict=False):
        if a != b:
            break
        n += 1
    return n


def shared_words(batches, columns: list[str]):
    """(row, words) of rows sorted by their first field and by their last, a run
    of words: how many at its begin any other run with the same first field
    shares. That is a neighbour in this order; at the ends of a task, whose
    neighbours are in others, all words count as shared."""
    last = before = None
    for pdf in batches:
        for row in zip(*(pdf[c] for c in columns), strict=True):
            if last is None:
                before = row[-1].count(" ")
            else:
                n = common_words(last[-1], row[-1]) if last[0] == row[0] else 0
                yield last, max(before, n)
                before = n
            last = row
    if last is not None:
        yield last, last[-1].count(" ")


def first_words(run: str, n: int) -> str:
    return "".join(w + " " for w in run.split(" ")[:n])


def trim(segments: DataFrame, window: int) -> DataFrame:
    """The segments of large shards without the words that no other segment of
    the shard shares on that side of the anchor; a row without a segment is a
    copy of an earlier one. Segments without a window are left out."""
    parts = num_partitions(segments)
    text = F.decode("segment", "ISO-8859-1")  # a character per byte, so that bytes can be cut and reversed
    before = F.call_function("substring_index", text, F.lit(" "), (F.col("at") - F.col("begin")).cast("int"))
    after = F.call_function("substring_index", text, F.lit(" "), (F.col("at") - F.col("stop")).cast("int"))
    sides = segments.select("h", "oid", "alt", "at", F.concat(after, F.lit(" ")).alias("right"), F.when(
        F.col("at") > F.col("begin"), F.concat(F.reverse(before), F.lit(" "))).otherwise("").alias("left"))
    of_left, of_right = ["h", "oid", "alt", "at", "right", "left"], ["h", "oid", "alt", "at", "left", "right"]

    def frames(rows, columns):
        held = []
        for row in rows:
            held.append(row)
            if len(held) >= 1000:
                yield pd.DataFrame(held, columns=columns)
                held = []
        yield pd.DataFrame(held, columns=columns)

    def cut_left(batches):
        yield from frames(((h, oid, alt, at, right, first_words(left, n))
                           for (h, oid, alt, at, right, left), n in shared_words(batches, of_left)
                           if n + right.count(" ") >= window), of_left)

    def cut_right(batches):
        met = Met()

        def rows():
            for (h, oid, alt, at, left, right), n in shared_words(batches, of_right):
                size = left.count(" ")
                if size + n < window:
                    continue
                segment = (left[::-1] + " " + first_words(right, n)).strip(" ").encode("latin-1")
                copy = met.before(h, segment, (oid, alt, at - size))
                yield 0 if copy else h, oid, alt, at - size, at, None if copy else segment, at + n
        yield from frames(rows(), _COLUMNS)

    kinds = {"h": "long", "oid": "long", "alt": "long", "at": "long", "left": "string", "right": "string"}
    # equal runs may be in several tasks, in order of place
    place = ["oid", "alt", "at"]
    half = cut_lineage(sides.repartitionByRange(parts, "h", "left", *place).sortWithinPartitions("h", "left", *place)
                       .mapInPandas(cut_left, ", ".join(f"{c} {kinds[c]}" for c in of_left)), "op10-left")
    return (half.repartitionByRange(parts, "h", "right", *place).sortWithinPartitions("h", "right", *place)
            .mapInPandas(cut_right, _SEGMENT))


def repeated_spans(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text"):
    """(documents, texts, spans): ``documents`` has oid, alt, null_id, n_words and
    sha of all words for each row; ``spans`` has oid, alt and the list of
    (begin, end) word spans to remove; ``texts`` has oid, alt, text of the documents that
    may have spans. oid and alt (the id with null as largest, a hash of the
    text) identify a document."""
    parts = num_partitions(docs)
    gram = min(GRAM, window)
    src = docs.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    src = src.select(F.coalesce("id", F.lit(LAST)).alias("oid"), F.col("id").isNull().alias("null_id"),
                     F.xxhash64("text").alias("alt"), "text")
    # names a document in the lists of anchors: a collision only adds candidates
    src = src.withColumn("uid", F.xxhash64("oid", "null_id", "alt"))

    def scan(batches):
        """A row per document. Anchors whose hash recurs in the task itself are
        known to repeat (sure); the others are left to the shuffle, together
        with one row without a document for each sure hash."""
        held, size = [], 0
        for pdf in batches:
            rows = zip(*(pdf[c] for c in ("uid", "oid", "alt", "null_id", "text")), strict=True)
            for some in together(rows):
                for (doc, words), (at, h) in zip(some, anchors([w for _, w in some], window), strict=True):
                    held.append((*doc, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), at, h))
                    size += len(at)
            if size > TOGETHER:
                yield from split(held)
                held, size = [], 0
        yield from split(held)

    def split(held):
        if not held:
            return
        every, place, n = np.unique(np.concatenate([r[-1] for r in held]), return_inverse=True, return_counts=True)
        twice, many = every[n > 1], n[place] > 1
        upto = 0
        for i in range(0, len(held), 1000):
            rows = []
            for *doc, at, h in held[i:i + 1000]:
                sure = many[upto:upto + len(h)]
                upto += len(h)
                rows.append((*doc, at[sure], h[sure], at[~sure], h[~sure]))
            yield pd.DataFrame(rows, columns=columns)
        for i in range(0, len(twice), 10_000):
            own = twice[i:i + 10_000]
            none = np.empty(0, dtype=np.int64)
            yield pd.DataFrame([(-1, -1, 0, False, -1, "", none, none, np.full(len(own), -1), own)], columns=columns)

    columns = ["uid", "oid", "alt", "null_id", "n_words", "sha", "sure_at", "sure_h", "at", "h"]
    scanned = cut_lineage(src.mapInPandas(
        scan, "uid long, oid long, alt long, null_id boolean, n_words long, sha string, "
              "sure_at array<long>, sure_h array<long>, at array<long>, h array<long>"), "op10-scan")

    def repeated(batches):
        """Anchors whose hash occurs more than once."""
        last, held = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            h = pdf["h"].to_numpy()
            before = np.concatenate([[last is not None and h[0] == last], h[1:] == h[:-1]])
            many = before | np.concatenate([h[1:] == h[:-1], [False]])
            if held is not None and before[0]:
                yield held
            yield pdf[many]
            last, held = h[-1], None if many[-1] else pdf.iloc[-1:]

    lone = scanned.select("uid", F.explode(F.arrays_zip("at", "h")).alias("z")).select("uid", "z.at", "z.h")
    lone = (lone.repartition(parts, "h").sortWithinPartitions("h")
            .mapInPandas(repeated, "uid long, at long, h long").where("at >= 0")
            .groupBy("uid").agg(F.collect_set(F.struct("at", "h")).alias("spots")))
    sure = scanned.where("size(sure_h) > 0").select("uid", F.transform(
        F.arrays_zip("sure_at", "sure_h"), lambda z: F.struct(z["sure_at"].alias("at"), z["sure_h"].alias("h"))).alias("spots"))
    # of equal rows one list will do: what is not sure in it is left to the shuffle, and recurs in the others
    sure = sure.groupBy("uid").agg(F.first("spots").alias("spots"))
    spots = lone.unionByName(sure).groupBy("uid").agg(F.flatten(F.collect_list("spots")).alias("spots"))
    # a shuffle at every size: the documents with repeated anchors grow with the data
    texts = cut_lineage(src.select("uid", "oid", "alt", "text").join(spots.hint("merge"), "uid"), "op10-texts")
    del lone, sure, spots
    release(docs.sparkSession)

    def cut(batches):
        """Segments around repeated anchors; copies of one met in this task are resolved at once."""
        met, doc = Met(), None
        for pdf in batches:
            out = []
            for oid, alt, text, spots in zip(pdf["oid"], pdf["alt"], pdf["text"], pdf["spots"], strict=True):
                if (oid, alt) == doc:
                    continue
                doc = (oid, alt)
                words = words_of(text)
                lo = hi = -1  # words that copies remove, as one span as long as they touch
                for at, h in sorted({(s["at"], s["h"]) for s in spots}):
                    if at + gram > len(words):
                        continue  # an anchor of another document with this uid; elsewhere it only adds a segment
                    begin, stop = max(0, at - (window - gram)), min(len(words), at + window)
                    segment = b" ".join(words[begin:stop])
                    if not met.before(h, segment, (oid, alt, begin)):
                        out.append((h, oid, alt, begin, at, segment, stop))
                        continue
                    if begin > hi:
                        if hi > lo:
                            out.append((0, oid, alt, lo, 0, None, hi))
                        lo = begin
                    hi = stop
                if hi > lo:
                    out.append((0, oid, alt, lo, 0, None, hi))
            yield pd.DataFrame(out, columns=_COLUMNS)

    segments = cut_lineage(texts.repartition(parts, "uid").sortWithinPartitions("oid", "alt").mapInPandas(
        cut, _SEGMENT), "op10-segments")
    release(docs.sparkSession)

    def search(batches):
        tail = None
        for pdf in batches:
            pdf = pdf if tail is None else pd.concat([tail, pdf])
            if not len(pdf):
                continue
            h = pdf["h"].to_numpy()
            end = int(np.searchsorted(h, h[-1]))  # the last shard may go on in the next batch
            tail = pdf.iloc[end:]
            yield shards(pdf.iloc[:end])
        if tail is not None:
            yield shards(tail)

    def shards(pdf):
        h = pdf["h"].to_numpy()
        oid, alt, begin, segment = (pdf[c].tolist() for c in ("oid", "alt", "begin", "segment"))
        found = []
        cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j - i > 1:
                found += shard_spans([((oid[r], alt[r]), begin[r], segment[r]) for r in range(i, j)], window)
        return pd.DataFrame([(*d, b, e) for d, b, e in found], columns=["oid", "alt", "begin", "stop"])

    found, fields = None, ["oid", "alt", "begin", "stop"]
    for step in [0, *group_sizes(window), None]:
        copies = segments.where("segment is null").select(fields)
        whole = segments.where("segment is not null")
        small, large = by_size(whole) if step is not None else (whole, None)
        searched = (small.select("h", "oid", "alt", "begin", "segment").repartition(parts, "h")
                    .sortWithinPartitions("h", "oid", "alt", "begin")
                    .mapInPandas(search, "oid long, alt long, begin long, stop long"))
        level = copies.unionByName(searched)
        found = level if found is None else found.unionByName(level)
        if large is None:
            break
        segments = cut_lineage(deal_again(large, window, step) if step else trim(large, window), f"op10-step{step}")
    spans = (found.groupBy("oid", "alt")
             .agg(F.collect_set(F.struct("begin", "stop")).alias("spans")))
    documents = scanned.where("n_words >= 0").select("oid", "alt", "null_id", "n_words", "sha")
    return documents, texts, cut_lineage(spans, "op10-spans")


def covered(n: int, spans) -> np.ndarray:
    """Flags of the words in any span."""
    flags = np.zeros(n + 1, dtype=np.int64)
    for s in spans:
        flags[s["begin"]] += 1
        flags[s["stop"]] -= 1
    return np.cumsum(flags[:-1]) > 0


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per input row."""
    documents, texts, spans = repeated_spans(docs, window, id_col, text_col)

    def strip(batches):
        for pdf in batches:
            rows = []
            for text, own in zip(pdf["text"], pdf["spans"], strict=True):
                words = words_of(text)
                gone = covered(len(words), own)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_removed", "kept"])
            yield pd.concat([pdf[["oid", "alt"]].reset_index(drop=True), out], axis=1)

    changed = (texts.select("oid", "alt", "text").join(spans, ["oid", "alt"])
               .mapInPandas(strip, "oid long, alt long, n_removed long, kept string").dropDuplicates(["oid", "alt"]))
    return (documents.join(changed, ["oid", "alt"], "left")
            .select(F.when(~F.col("null_id"), F.col("oid")).alias("doc_id"), "n_words",
                    F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("kept", "sha").alias("kept_sha256")))


def remove_repeats(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the texts without their repeated spans; what
    stays keeps its white space, and texts without repeats are unchanged."""
    import re

    _, _, spans = repeated_spans(docs, window, id_col, text_col)
    word = re.compile(r"[^\x20\x09-\x0D]+")

    @F.pandas_udf("string")
    def strip(texts: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for text, s in zip(texts, own, strict=True):
            if s is not None and len(s):
                places = [m.span() for m in word.finditer(text)]
                gone, kept, upto = covered(len(places), s).tolist(), [], 0
                for i, g in enumerate(gone):
                    if g:
                        if i == 0 or not gone[i - 1]:
                            kept.append(text[upto:places[i][0]])
                        upto = places[i + 1][0] if i + 1 < len(places) else places[i][1]
                text = "".join([*kept, text[upto:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(col(id_col).cast("long"), F.lit(LAST)).alias("oid"),
                        F.xxhash64(text_of(text_col)).alias("alt"))
    joined = keyed.join(spans, ["oid", "alt"], "left")
    text = F.col("row")[text_col]
    fresh = F.when(F.col("spans").isNull(), text).otherwise(strip(F.coalesce(text, F.lit("")), F.col("spans")))
    return joined.withColumn("fresh", fresh).select(
        *(F.col("fresh").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))

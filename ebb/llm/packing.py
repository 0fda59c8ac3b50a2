"""Best-fit-decreasing packing of documents into sequences of bounded length.

Best-fit decreasing takes documents from long to short and puts each into the
open sequence with the least room that still holds it. Documents of one length
are interchangeable, so the packing depends on the number of documents per
length only: at most ``capacity`` counts. ``plan_bins`` runs the whole
corpus's best-fit decreasing over these counts on the driver, with a segment
tree over the remaining capacities, and moves runs of equal documents at once;
its work and output depend on ``capacity``, not on the corpus. The result is
the packing that a single machine would make of all documents together.

In Spark: (1) one scan encodes, cuts and writes a row per piece with its task
and its number among the task's pieces of that length; (2) counts per (length,
task) give each task a first rank per length; (3) a broadcast of the plan (one
row per length) turns (length, rank) into sequence and offset. Texts and ids
are never shuffled, and no group is gathered anywhere.

Edge cases: a null or empty text is its end id; rows that repeat an id are
separate documents; pieces longer than the capacity cannot occur; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut_lineage, text_of
from .tokens import byte_bpe

_PIECE = ("doc_id long, null_id boolean, piece int, start long, length long, ids_crc32 long, "
          "task long, nth long")


class OpenBins:
    """Segment tree over remaining capacities 0..top: the smallest remaining
    capacity of at least ``need`` that has open sequences."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.any = [False] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, room: int) -> None:
        i = room + self.size
        self.any[i] = bool(self.runs.get(room))
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def push(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.runs.setdefault(room, []).append((first, n))
            self._mark(room)

    def pop(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def tightest(self, need: int) -> int | None:
        i = need + self.size
        while not self.any[i]:
            while i & 1:  # a right child: go up until there is a right sibling
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf of this level
                return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, rank_end, rank_begin, per_bin, first_bin, offset):
    pieces of that length with rank in [begin, end) go, ``per_bin`` to a bin,
    into the bins from first_bin on, from that offset on."""
    bins, used, out = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, run = capacity, (used, -(-left // (capacity // length)))
                used += run[1]
            else:
                run = bins.pop(room)
            first, n = run
            per = room // length  # a bin that took one piece is the tightest for the next
            full = min(n, left // per)
            if full:
                out.append((length, rank + full * per, rank, per, first, capacity - room))
                bins.push(room - per * length, first, full)
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if n and left and left < per:
                out.append((length, rank + left, rank, left, first, capacity - room))
                bins.push(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            bins.push(room, first, n)
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. Longer documents are cut into full pieces; what is
    left over is the first piece."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        encode, end = byte_bpe(tokenizer).encode, np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc, null_id, text in zip(pdf["id"], pdf["null_id"], pdf["text"], strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                begin, piece = 0, 0
                while begin < n:
                    size = (n - begin) % capacity or capacity
                    crc = zlib.crc32(ids[4 * begin:4 * (begin + size)])
                    rows.append((doc, null_id, piece, begin, size, crc, task, seen[size]))
                    seen[size] += 1
                    begin, piece = begin + size, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "null_id", "piece", "start", "length",
                                              "ids_crc32", "task", "nth"])

    return (docs.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
            .select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("null_id"), "text")
            .mapInPandas(cut, _PIECE))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = cut_lineage(cut_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "packing-pieces")
    per_task = cut_lineage(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "packing-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    plan = spark.createDataFrame(
        plan_bins(counts, capacity),
        "length long, rank_end long, rank_begin long, per_bin long, first_bin long, at long")
    # at most one row per length, with a bounded number of placements each
    plan = plan.groupBy("length").agg(F.collect_list(F.struct(
        "rank_end", "rank_begin", "per_bin", "first_bin", "at")).alias("places"))
    ranked = (pieces.join(first, ["length", "task"]).withColumn("rank", F.col("first") + F.col("nth"))
              .join(F.broadcast(plan), "length")
              .withColumn("p", F.array_min(F.filter("places", lambda p: p["rank_end"] > F.col("rank")))))
    k = F.col("rank") - F.col("p.rank_begin")
    return ranked.select(
        F.when(~F.col("null_id"), F.col("doc_id")).alias("doc_id"), "piece", "start", "length", "ids_crc32",
        (F.col("p.first_bin") + F.floor(k / F.col("p.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("p.at") + (k % F.col("p.per_bin")) * F.col("length")).cast("long").alias("offset"))

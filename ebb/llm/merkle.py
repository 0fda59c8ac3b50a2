"""Merkle manifest of a table: one hash tree per group and one over the groups,
with a witness (the siblings on the way to the root) for every row.

H is the lowercase hex SHA-256 of its inputs' concatenation, digests as hex
text. A leaf is H over the row's fields, each ``-`` if null, else UTF-8 byte
count, ``:``, value. Leaves of a group ascend by id; while several nodes
remain, every ``ARITY`` consecutive ones (the last run may be shorter, even one
node) become their H. The group roots, ordered by group (null first, UTF-8
bytewise), give the root in the same way.

Method: incremental witnesses. ``Appender`` takes the nodes of an aligned block
one by one, holds only the open run of each level, and when a run closes it
extends the partial witnesses of the nodes below by their new siblings. A task
appends the ``BLOCK`` nodes of one block; the block roots are then the nodes of
the next tier, appended in the same way, until one node of a group is left. A
row's full witness is the part made in its own block followed by those of its
block roots. Because blocks are aligned to a power of the arity, the tree is
the one a single sequential append would build.

Plan. Leaves are hashed in the JVM, so texts are never shuffled; positions come
from running totals over ranges; a block holds ``BLOCK`` rows at most, however
large its group. Tiers shrink by the factor BLOCK, so a handful of rounds
serves any table. The driver holds no node: rounds end by a count.

Edge cases: null ids come first, rows that repeat an id follow by their leaf,
equal rows are separate leaves; a null group is a group of its own. A lone leaf
is its group's root, a lone group's root is the root; a row without siblings
has the empty witness. An empty table gives no rows. Further columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cumulative import prefix_sums
from .common import col, cut_lineage, num_partitions, sorted_groups

ARITY, HEIGHT = 8, 4
BLOCK = ARITY ** HEIGHT


def field(value: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, ``:`` and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def node_hash(digests: Sequence[bytes]) -> bytes:
    """H of binary digests, which enter as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class Appender:
    """Appends the nodes of one aligned block. ``witness[i]`` grows level by
    level: a byte with the place in the run, a byte with the number of siblings,
    and the siblings' digests from left to right."""

    def __init__(self):
        self.witness: list[bytearray] = []
        self.open: list[list[tuple[bytes, int, int]]] = []   # per level: (digest, first, last + 1)

    def append(self, digest: bytes) -> None:
        i = len(self.witness)
        self.witness.append(bytearray())
        self._push(0, (digest, i, i + 1))

    def _push(self, level: int, node) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == ARITY and level < HEIGHT:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for place, (_, lo, hi) in enumerate(run):
            step = bytes([place, len(run) - 1]) + b"".join(d for d, _, _ in run[:place] + run[place + 1:])
            for i in range(lo, hi):
                self.witness[i] += step
        self._push(level + 1, (node_hash([d for d, _, _ in run]), run[0][1], run[-1][2]))

    def finish(self, alone: bool) -> bytes:
        """Closes the open runs and returns the block's root. The only block of a
        group (``alone``) stops at one node, any other climbs to full height."""
        level = 0
        while level < min(HEIGHT, len(self.open)):
            rest = sum(len(run) for run in self.open[level + 1:])
            if self.open[level] and not (alone and len(self.open[level]) == 1 and not rest):
                self._close(level)
            level += 1
        return next(run for run in reversed(self.open) if run)[0][0]


def fold(digest: bytes, witness: bytes) -> bytes:
    """The root that a digest and the siblings of a witness lead to."""
    at = 0
    while at < len(witness):
        place, n = witness[at], witness[at + 1]
        run = [witness[at + 2 + 32 * i:at + 34 + 32 * i] for i in range(n)]
        digest = node_hash(run[:place] + [digest] + run[place:])
        at += 2 + 32 * n
    return digest


def siblings(witness: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(witness):
        n = witness[at + 1]
        out += [witness[at + 2 + 32 * i:at + 34 + 32 * i] for i in range(n)]
        at += 2 + 32 * n
    return out


def _tier(nodes: DataFrame, name: str) -> DataFrame:
    """One tier over (g, pos, tag, digest): kind 0 is a node with its witness
    inside its block, kind 1 a block root at its place in the next tier, kind 2
    the root of a group."""
    def run(batches):
        for (g, block), pdf in sorted_groups(batches, ["g", "block"]):
            tree = Appender()
            for d in pdf["digest"]:
                tree.append(bytes(d))
            # a full first block is not known to be alone: its root goes one tier
            # further, and a lone root stays as it is there
            alone = block == 0 and len(pdf) < BLOCK
            root = tree.finish(alone)
            yield pd.DataFrame({"kind": 0, "g": g, "pos": pdf["pos"], "tag": pdf["tag"], "digest": pdf["digest"],
                                "witness": [bytes(w) for w in tree.witness]})
            yield pd.DataFrame({"kind": [2 if alone else 1], "g": [g], "pos": [block], "tag": [block],
                                "digest": [root], "witness": [b""]})

    keyed = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
    keyed = keyed.repartition(num_partitions(nodes), "g", "block").sortWithinPartitions("g", "block", "pos")
    return cut_lineage(keyed.select("g", "block", "pos", "tag", "digest").mapInPandas(
        run, "kind int, g string, pos long, tag long, digest binary, witness binary"), name)


def grow(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The trees over (g, pos, tag, digest). Returns (g, pos, tag, witness up to
    the group's root) of every node and (g, digest) of the group roots."""
    tiers, roots = [], None
    while True:
        t = _tier(nodes, f"{name}-tier{len(tiers)}")
        tiers.append(t.where("kind = 0").select("g", "pos", "tag", "witness"))
        done = t.where("kind = 2").select("g", "digest")
        roots = done if roots is None else roots.unionByName(done)
        nodes = t.where("kind = 1").select("g", "pos", "tag", "digest")
        if nodes.isEmpty():
            break
    paths = tiers.pop()
    for tier in reversed(tiers):
        above = paths.select(F.col("g").alias("g1"), F.col("pos").alias("block"), F.col("witness").alias("above"))
        own = F.floor(F.col("pos") / BLOCK).cast("long")
        # a block has BLOCK rows at most, so no key of this join is hot
        paths = tier.withColumn("own", own).join(
            above, (F.col("g") == F.col("g1")) & (F.col("own") == F.col("block")), "left").select(
            "g", "pos", "tag", F.concat("witness", F.coalesce("above", F.lit(b""))).alias("witness"))
    return paths, roots


def group_key(group: Column) -> Column:
    """Never null, and in the order null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def merkle_manifest(leaves: DataFrame) -> DataFrame:
    """For (group, id, leaf hex, further columns) the columns subroot, root (hex)
    and witness (binary, for :func:`fold`) besides those of the input."""
    named = leaves.withColumns({"__g": group_key(F.col("group")), "__digest": F.unhex("leaf")})
    named = cut_lineage(named.withColumn("__uid", F.monotonically_increasing_id()), "op12-leaves")
    order = F.struct(F.col("id"), F.col("leaf"), F.col("__uid"))
    light = named.select("__g", "__uid", "__digest", order.alias("__order"), F.lit(1).cast("long").alias("__one"))
    light = cut_lineage(light, "op12-order")
    placed = prefix_sums(light, ["__g"], "__order", ["__one"])
    placed = cut_lineage(placed.select(F.col("__uid").alias("tag"), F.col("__g").alias("g"), (F.col("cum___one") - 1).alias("pos"),
                                       F.col("__digest").alias("digest")), "op12-placed")
    paths, roots = grow(placed, "op12")
    tops = cut_lineage(roots.select(F.lit("").alias("__top"), F.col("g").alias("__key"), F.col("digest").alias("__sub"),
                                    F.lit(1).cast("long").alias("__one")), "op12-roots")
    tops = prefix_sums(tops, ["__top"], "__key", ["__one"])
    tops = cut_lineage(tops.select(F.col("__key").alias("g"), F.col("__sub").alias("sub"),
                                   (F.col("cum___one") - 1).alias("pos")), "op12-tops")
    top_paths, root = grow(tops.select(F.lit("").alias("g"), "pos", F.col("pos").alias("tag"),
                                       F.col("sub").alias("digest")), "op12-top")
    top = root.first()                            # one digest, none for an empty table
    tops = tops.join(top_paths.select("pos", F.col("witness").alias("above")), "pos").select(
        "g", F.lower(F.hex("sub")).alias("subroot"), F.lit(bytes(top["digest"]).hex() if top else None).alias("root"), "above")
    tops = cut_lineage(tops, "op12-groups")
    # a group may hold any share of the rows: AQE broadcasts the few rows of `tops` or splits its hot keys
    whole = paths.join(tops, "g").select(F.col("tag").alias("__uid"), "subroot", "root",
                                         F.concat("witness", "above").alias("witness"))
    return named.join(whole, "__uid").drop("__g", "__uid", "__digest")


def verified_documents(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
                       fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
                       text_col: str = "text", tamper_mod: int = 3) -> DataFrame:
    """The manifest of a table and a check of each row's witness against a copy of
    the table in which the texts of some rows (``crc32(id)`` divisible by
    ``tamper_mod``) were lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = [F.translate(col(f), upper, lower) if f == text_col else col(f) for f in fields]
    hit = F.pmod(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(tamper_mod)) == 0
    leaf = leaf_of([col(f) for f in fields])
    leaves = docs.select(col(group_col).alias("group"), col(id_col).cast("long").alias("id"), leaf.alias("leaf"),
                         F.when(F.coalesce(hit, F.lit(False)), leaf_of(changed)).otherwise(leaf).alias("seen"))
    rows = merkle_manifest(leaves)

    def check(batches):
        for pdf in batches:
            wit = [bytes(w) for w in pdf["witness"]]
            pdf["proof_sha256"] = [node_hash(siblings(w)).hex() for w in wit]
            pdf["folded_root"] = [fold(bytes.fromhex(s), w).hex() for s, w in zip(pdf["seen"], wit, strict=True)]
            yield pdf[["doc_id", "missing", "leaf", "subroot", "root", "proof_sha256", "folded_root"]]

    rows = rows.select(F.coalesce("id", F.lit(0)).alias("doc_id"), F.col("id").isNull().alias("missing"),
                       "leaf", "seen", "subroot", "root", "witness")
    out = rows.mapInPandas(check, "doc_id long, missing boolean, leaf string, subroot string, root string, "
                                  "proof_sha256 string, folded_root string")
    return out.select(F.when(~F.col("missing"), F.col("doc_id")).alias("doc_id"), "leaf", "subroot", "root",
                      "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

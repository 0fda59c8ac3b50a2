"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns
the documents that stay, with all their columns.

Rows are matched to decisions by doc_id (a null one is matched like any other).
After exact dedup, rows that repeat an id differ in their texts; from then on
they share the decision of their id.
Thresholds: near-duplicates are documents whose five-word shingle sets have a
Jaccard similarity of at least 0.8; repeated passages are windows of 50 words.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common
from .common import text_of
from .exact_dedup import exact_dedup, normalised
from .ngram_join import ngram_join
from .packing import pack
from .queries import BYTE_BPE
from .substring_dedup import remove_repeats
from .toxicity import fit_grammar, score_toxicity

SHINGLE, JACCARD = 5, (80, 100)
WINDOW = 50


def drop_toxic(spark, docs, sf_dir):
    """Toxicity (5): documents with a score of 0.5 or more go."""
    grammar = fit_grammar(docs, common.table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, grammar, score_col="__score")
    return scored.where("__score < 0.5").drop("__score")


def drop_copies(spark, docs, sf_dir):
    """Exact dedup (1): the row with the most code points, then the smallest id, of each class stays."""
    kept = exact_dedup(docs).where("kept")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _with_ids(docs, kept)
    # ids repeat: match the text as well, and keep the longest row of those that share both
    sha = F.sha2(normalised(text_of("text")).cast("binary"), 256)
    rows, kept = docs.distinct().withColumn("__sha", sha), kept.select("doc_id", F.col("text_sha256").alias("__sha"))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["__sha"] == kept["__sha"]), "left_semi")
    best = Window.partitionBy("doc_id", "__sha").orderBy(F.desc(F.char_length(text_of("text"))), *docs.columns)
    return rows.withColumn("__nth", F.row_number().over(best)).where("__nth = 1").drop("__sha", "__nth")


def drop_near_copies(spark, docs, sf_dir):
    """N-gram Jaccard join (6): the smallest id of each connected group stays.
    Documents without a shingle are in no group."""
    joined = ngram_join(docs, SHINGLE, *JACCARD)
    return _with_ids(docs, joined.where("doc_id <=> component_id").distinct())


def drop_passages(spark, docs, sf_dir):
    """Substring dedup (10): words covered by a window that starts earlier go; n_chars follows the text."""
    out = remove_repeats(docs, WINDOW)
    if "n_chars" in out.columns:
        kind = out.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out


def pack_documents(spark, docs, sf_dir):
    """Best-fit packing (4): a row per piece, in sequences of at most 1024 tokens."""
    return pack(docs, BYTE_BPE, end_id=2, capacity=1024)


def _with_ids(docs, kept):
    """The rows of ``docs`` whose id is in ``kept``; a null id is an id."""
    kept = kept.select(F.col("doc_id").alias("__id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi")

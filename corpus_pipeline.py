"""The corpus pipeline over the documents table: toxic documents go, one of each
class of exact copies stays, one of each group of near copies stays, repeated
passages go, and what is left is packed into training sequences. Each stage's
result is written as Parquet and read again by the next one.
"""

from __future__ import annotations

from ebb.llm import stages
from ebb.llm.common import cut_lineage, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("exact_dedup", stages.drop_copies),
    ("ngram_jaccard", stages.drop_near_copies),
    ("substring_dedup", stages.drop_passages),
    ("best_fit_packing", stages.pack_documents),
]

#: No SQL twin: learned scores, tokenizers and packing; tests check it by brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed pieces of the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

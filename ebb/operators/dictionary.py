"""Check of category values against a dictionary, with the nearest entry.

Values that are no entry are found by an anti join of the distinct values. Their nearest
entry comes from a deletion neighbourhood: two texts within edit distance d
share a text that both become by deleting at most d letters, so an equi-join
on these variants finds every pair within d, and none of all pairs is formed.
The edit distance then decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletions(text: Column, distance: int) -> Column:
    """All texts that arise by deleting at most ``distance`` letters."""
    out = F.array(text)
    for _ in range(distance):
        shorter = F.flatten(F.transform(out, lambda s: F.when(F.length(s) > 0, F.transform(
            F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))
            .otherwise(F.array(s))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def dictionary_check(df: DataFrame, column: str, dictionary: DataFrame, entry: str = "entry", distance: int = 2) -> DataFrame:
    """``(value, n_rows, nearest, edits)`` per value outside the dictionary:
    the nearest entry within ``distance`` edits (ties in the order of entries),
    null if there is none. Null values are not checked. Variants grow with
    length^distance."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n_rows"))
    entries = dictionary.select(F.col(entry).cast("string").alias("entry")).where("entry IS NOT NULL").distinct()
    odd = values.join(entries, F.col("value") == F.col("entry"), "left_anti")
    left = odd.select("value", F.explode(deletions(F.col("value"), distance)).alias("variant"))
    right = entries.select("entry", F.explode(deletions(F.col("entry"), distance)).alias("variant"))
    near = left.join(right, "variant").select("value", "entry").distinct().withColumn("edits", F.levenshtein("value", "entry"))
    best = near.where(F.col("edits") <= distance).groupBy("value").agg(F.min(F.struct("edits", "entry")).alias("b"))
    return odd.join(best, "value", "left").select("value", "n_rows", F.col("b.entry").alias("nearest"), F.col("b.edits").alias("edits"))

"""Joins whose keys may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of the rows is met by a broadcast; there are
#: at most as many such keys.
SHARES = 1000


def keyed_join(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join with ``keyed``, which is unique in ``key`` and has the number
    of rows per key in ``size``. Rows of hot keys stay where they are and meet
    a broadcast of at most ``SHARES`` keys; the others are shuffled, and none
    of them is hot."""
    limit = max(total // SHARES, 1)
    hot, cold = keyed.where(F.col(size) > limit), keyed.where(F.col(size) <= limit)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(cold, key))

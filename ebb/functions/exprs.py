"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its literal name (dots, spaces and quotes allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def norm_name(name: str) -> str:
    """Column-name normal form: lower case, trimmed, spaces to underscores."""
    return name.lower().strip().replace(" ", "_")


def bin_by_edges(v: Column, edges: Column) -> Column:
    """1-based quartile bin of ``v`` for a 5-entry edge array.

    Quantile edges when all five are distinct (right-closed bins, lowest value
    included); otherwise four equal-width bins over ``[min, max]`` (edges at
    ``min + k * (max - min) / 4``), and bin 2 for a constant column.
    """
    e1, e2, e3 = edges[1], edges[2], edges[3]
    mn, mx = edges[0], edges[4]
    step = (mx - mn) / 4.0

    def count_above(b1, b2, b3):
        return (F.lit(1) + (v > b1).cast("int") + (v > b2).cast("int")
                + (v > b3).cast("int"))

    return (F.when(F.size(F.array_distinct(edges)) == 5, count_above(e1, e2, e3))
            .when(mn == mx, F.lit(2))
            .otherwise(count_above(F.lit(1) * step + mn, F.lit(2) * step + mn,
                                   F.lit(3) * step + mn)))


def bin_cuts(edges: Column) -> list[Column]:
    """Three cuts per edge array with ``bin_by_cuts(v, cuts) = bin_by_edges(v, edges)``
    for every finite ``v``: many rows of one group need not derive them again."""
    mn, mx = edges[0], edges[4]
    step = (mx - mn) / 4.0
    quartiles, constant = F.size(F.array_distinct(edges)) == 5, mn == mx
    whole = [F.lit(float("-inf")), F.lit(float("inf")), F.lit(float("inf"))]
    return [F.when(quartiles, edges[k]).when(constant, whole[k - 1]).otherwise(mn + k * step) for k in (1, 2, 3)]


def bin_by_cuts(v: Column, cuts: Sequence[Column]) -> Column:
    """1 and one more for every cut that ``v`` exceeds."""
    return F.lit(1) + sum((v > c).cast("int") for c in cuts)


def segment_rule(r: Column, f: Column, m: Column) -> Column:
    """RFM segment, first matching rule wins."""
    return (F.when((r == 4) & (f == 4) & (m >= 3), "Champions")
            .when((r <= 2) & (f >= 3) & (m >= 3), "At Risk")
            .when((r == 1) & (f == 1) & (m <= 2), "Lost")
            .when((r <= 2) & (f <= 2), "Hibernating")
            .when((r >= 3) & (f >= 2) & (m >= 2), "Loyal")
            .when(r <= 2, "Hibernating")
            .otherwise("Loyal"))


def order_rank(col: Column, order: Sequence[str], other: int = 99) -> Column:
    """Position of ``col`` in a fixed list (``other`` when absent)."""
    expr = F.lit(other)
    for i, name in reversed(list(enumerate(order))):
        expr = F.when(col == name, F.lit(i)).otherwise(expr)
    return expr


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def is_numeric_type(dt) -> bool:
    """Numeric in the reference's sense: ints and floats; bool and dates are not."""
    from pyspark.sql.types import NumericType
    return isinstance(dt, NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def fixed_decimals(x: Column, digits: int) -> Column:
    """``x`` with ``digits`` decimals, rounded half-even on the exact binary
    value (as Python's ``f"{x:.2f}"`` and C's ``printf``); Java's ``%.2f``
    rounds the shortest decimal string half-up instead."""
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def ntz_as_utc_instant(c: Column) -> Column:
    """``TIMESTAMP_NTZ`` -> ``TIMESTAMP`` whose UTC wall time is the same,
    whatever the session time zone (watermarks need zoned timestamps)."""
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    micros = (days * 86400000000 + F.hour(c).cast("long") * 3600000000
              + F.minute(c).cast("long") * 60000000
              + (F.date_part(F.lit("SECOND"), c) * 1000000).cast("long"))
    return F.timestamp_micros(micros)


def utc_instant_as_ntz(c: Column) -> Column:
    """Inverse of :func:`ntz_as_utc_instant`: the instant's UTC wall time."""
    secs = (F.unix_micros(c).cast("decimal(20,0)") / 1000000).cast("decimal(18,6)")
    return (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs))

"""Joins on order and overlap, by shuffles on keys alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import unused


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, columns: Sequence[str]) -> DataFrame:
    """``left`` with ``columns`` of the latest row of ``right`` in the same ``by`` whose ``at`` is not after its own; nulls without one.

    Both are put into one table and sorted by key and ``at``, so a row costs
    the same however many of the other side it follows. Rows of ``right`` with
    equal ``at`` are told apart by the columns themselves, the greatest counts.
    """
    side, held = unused(left, "side"), unused(left, "held")
    a = left.select("*", F.lit(1).alias(side), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias(held))
    keyed = right.groupBy(*by, at).agg(F.max(F.struct(*columns)).alias(held))
    b = keyed.select(*(F.col(c) if c in (*by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.lit(0).alias(side), held)
    w = Window.partitionBy(*by).orderBy(F.col(at), F.col(side))
    out = a.unionByName(b).withColumn(held, F.last(held, ignorenulls=True).over(w)).where(F.col(side) == 1)
    return out.select(*left.columns, *(F.col(held)[c].alias(c) for c in columns))


def overlaps(left: DataFrame, right: DataFrame, by: Sequence[str], step: float) -> DataFrame:
    """Pairs of intervals [begin, end) of ``left`` and ``right`` that overlap, in the same ``by``; ``right`` has ``other_begin`` and ``other_end``.

    Intervals are spread over cells of ``step``, which are joined for equality;
    a pair counts in the cell where the later one begins, so it comes once.
    """
    cell = unused(left, "cell")
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / step), F.ceil(F.col(b) / step) - 1))
    a = left.where("begin < end").withColumn(cell, cells("begin", "end"))
    b = right.where("other_begin < other_end").withColumn(cell, cells("other_begin", "other_end"))
    both = a.join(b, [*by, cell])
    first = F.greatest("begin", "other_begin")
    return both.where((first < F.least("end", "other_end")) & (F.floor(first / step) == F.col(cell))).drop(cell)

"""Series of any length in ranges: tasks hold stretches of a series, and a few numbers of each stretch connect them.

Most series fit a task, and then one shuffle by their keys is cheapest.  Those of more than
`WHOLE_ROWS` rows, as a first count per key tells, are cut at ranges of (keys, order): each range
sums up what later ones need of it, a small second level carries that on, and each range is done again
from what it was given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: Rows of a key that one task takes in order.
WHOLE_ROWS = 2_000_000
RANGE = "_range"


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_long_{k}")) for k in keys))


def long_keys(counts: DataFrame, keys: Sequence[str], most: int) -> DataFrame | None:
    """Of (keys, n) with several rows a key: the keys of more than `most`, written; None if there are none.

    This is a job over what is counted, so what costs much to make should be written before.
    """
    found = counts.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") > most).select(*[F.col(k).alias(f"_long_{k}") for k in keys])
    found = written(found)
    return None if found.isEmpty() else found


def counted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def split(df: DataFrame, keys: Sequence[str], long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of other keys, rows of long keys)."""
    return df.join(long, _same(keys), "left_anti"), df.join(long, _same(keys), "left_semi")


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with its range, written, so that all that follows sees the same ranges; rows of equal order share one."""
    return written(df.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()))


def earlier(rows: DataFrame, keys: Sequence[str], **found: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """rows with, for each name, what all earlier ranges of their keys give: (aggregate of a range, how ranges' values combine)."""
    per = rows.groupBy(*keys, RANGE).agg(*[a.alias(n) for n, (a, _) in found.items()])
    w = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*[F.col(k).alias(f"_long_{k}") for k in keys], F.col(RANGE).alias("_r"), *[combine(n).over(w).alias(n) for n, (_, combine) in found.items()])
    return rows.join(carried, _same(keys) & (F.col(RANGE) == F.col("_r"))).drop("_r", *[f"_long_{k}" for k in keys])


def given(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns of (keys, range, ...) that a scan of ranges made."""
    named = carried.withColumnsRenamed({k: f"_long_{k}" for k in keys} | {RANGE: "_r"})
    return rows.join(named, _same(keys) & (F.col(RANGE) == F.col("_r"))).drop("_r", *[f"_long_{k}" for k in keys])


def last(name: str) -> Column:
    return F.last(name, ignorenulls=True)

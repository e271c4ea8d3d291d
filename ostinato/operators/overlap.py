"""Overlap-add: where chunks stand, how they are weighted, and their weighted mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stride_of(segment: int, overlap: float) -> int:
    return int((1 - overlap) * segment)


def placements(tracks: DataFrame, keys: Sequence[str], total: str, segment: int, overlap: float = 0.25) -> DataFrame:
    """A row per chunk of each track: offset, valid, read_start, read_length, pad_left, trim_start.

    Chunks start a stride apart; a short last one is read in the middle of a full segment, as far as there is signal.
    """
    rows = tracks.select(*keys, F.col(total).cast("long").alias("_n")).filter("_n > 0")
    rows = rows.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(stride_of(segment, overlap)).cast("long"))))
    rows = rows.withColumn("valid", F.least(F.lit(segment), F.col("_n") - F.col("offset")))
    lead = F.floor((F.lit(segment) - F.col("valid")) / 2)
    begin, stop = F.col("offset") - lead, F.col("offset") - lead + segment
    rows = rows.withColumn("read_start", F.greatest(F.lit(0), begin)).withColumn("read_length", F.least(F.col("_n"), stop) - F.col("read_start"))
    return rows.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("offset", "valid", "read_start", "read_length")], F.greatest(F.lit(0), -begin).cast("long").alias("pad_left"), lead.cast("long").alias("trim_start"))


def weight(index: Column, segment: int, power: float = 1.0) -> Column:
    """A triangle over the segment: 1 / half at its first place, 1 at its top."""
    half = segment // 2
    ramp = F.when(index < half, index + 1).otherwise(segment - index)
    return F.pow(ramp / max(half, segment - half), F.lit(power))


def overlap_add(values: DataFrame, keys: Sequence[str], frame: str, index: str, value: str, segment: int, power: float = 1.0) -> DataFrame:
    """(keys, frame, value): the weighted mean of what all chunks say about a frame; two sums that reduce before the shuffle."""
    w = weight(F.col(index), segment, power)
    return values.groupBy(*keys, frame).agg((F.sum(w * F.col(value)) / F.greatest(F.sum(w), F.lit(1e-8))).alias(value))

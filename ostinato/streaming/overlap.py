"""Streaming forms: overlap-add that ends a frame once no later chunk can reach it, and windowed energy.

Frames are event time, one second each.  The watermark trails the newest frame by a segment:
chunks come in rising order, so a frame that lies that far back is final and is emitted once.
Rows behind the watermark are late and are dropped, where an in-order reader would fail.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.overlap import weight


def overlap_add(values: DataFrame, keys: Sequence[str], frame: str, index: str, value: str, segment: int, power: float = 1.0) -> DataFrame:
    """(keys, frame, value) of finished frames, in append mode.  `closing` rows flush the rest.

    State holds two segments at most: a row whose place lies outside its segment fails the query.
    """
    inside = F.col(index).between(0, segment - 1)
    values = values.withColumn(index, F.when(inside | F.col(value).isNull(), F.col(index)).otherwise(F.raise_error(F.concat(F.lit("outside the segment: "), F.col(index).cast("string")))))
    w = weight(F.col(index), segment, power)
    w = F.when(F.col(value).isNull(), 0.0).otherwise(w)
    timed = values.withColumn("_at", F.timestamp_seconds(frame)).withWatermark("_at", f"{segment} seconds")
    sums = timed.groupBy(*keys, F.window("_at", "1 second").alias("_w")).agg(F.sum(w * F.coalesce(F.col(value), F.lit(0.0))).alias("_s"), F.sum(w).alias("_t"))
    done = sums.filter("_t > 0")
    return done.select(*keys, F.unix_seconds("_w.start").alias(frame), (F.col("_s") / F.greatest(F.col("_t"), F.lit(1e-8))).alias(value))


def closing(last: DataFrame, frame: str, index: str, value: str, segment: int) -> DataFrame:
    """A row for each row of `last` that lies far enough ahead to make all frames final; it has no value of its own."""
    return last.withColumn(frame, F.col(frame) + 2 * segment + 2).withColumn(index, F.lit(0).cast(last.schema[index].dataType)).withColumn(value, F.lit(None).cast(last.schema[value].dataType))


def energy(events: DataFrame, keys: Sequence[str], at: str, value: str, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(keys, begin, energy) of tumbling or hopping windows, each emitted when the watermark passes it."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    sums = events.withWatermark(at, delay).groupBy(*keys, window.alias("_w")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("energy"))
    return sums.select(*keys, F.col("_w.start").alias("begin"), "energy")

"""Tags of stems from a model's scores of short patches: pooled by mean, then mapped to instruments.

A patch is a row (keys, patch, scores array).  Sums are taken per task first, so one row a stem and
task is shuffled, whatever the number of patches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stems import CLASS_PROGRAMS

# fixed values: the model's classes, its sample rate, and the least mean score that counts
CLASSES, TAG_RATE, LEAST_SCORE = 521, 16_000, 0.05
#: Stems that a task sums at once.
_OPEN = 2000


def _summed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, sums) of (keys, n, sums), added up within each task; a stem may have several rows."""
    width = len(keys)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            sums = [v[1] for v in open_.values()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sums])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sums)))
            columns = [pa.array([k[j] for k in open_], df_kinds[j]) for j in range(width)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([v[0] for v in open_.values()], pa.int64()), lists], names=[*keys, "n", "sums"])

        for batch in batches:
            df_kinds = [batch.schema.field(j).type for j in range(width)]
            own = list(zip(*(batch.column(j).to_pylist() for j in range(width)), strict=True))
            n = batch.column(width).to_numpy()
            lists = batch.column(width + 1)
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for k, key in enumerate(own):
                x = flat[at[k] : at[k + 1]].astype(np.float64)
                if key not in open_:
                    open_[key] = [0, np.zeros(0)]
                v = open_[key]
                if len(x) > len(v[1]):
                    v[1] = np.concatenate([v[1], np.zeros(len(x) - len(v[1]))])
                v[0] += int(n[k])
                v[1][: len(x)] += x
                if len(open_) > _OPEN:
                    yield out()
                    open_ = {}
        if open_:
            yield out()

    return df.select(*keys, "n", "sums").mapInArrow(run, f"{kinds}, n long, sums array<double>")


def pooled(patches: DataFrame, keys: Sequence[str], scores: str = "scores") -> DataFrame:
    """(keys, n, means): the mean of the scores of all patches, place by place; null scores are no patch.

    Lists may differ in length: places that a patch lacks count as 0.
    """
    rows = patches.filter(F.col(scores).isNotNull()).select(*keys, F.lit(1).cast("long").alias("n"), F.transform(scores, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("sums"))
    parts = _summed(rows, keys)
    # a row a stem and task: those of a stem meet in one task, which adds them up in a pass
    whole = _summed(parts.repartition(*keys).sortWithinPartitions(*keys), keys).groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list("sums").alias("s"))
    added = F.aggregate(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), F.get("s", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
    return whole.select(*keys, "n", F.transform(added, lambda x: x / F.col("n")).alias("means"))


def best_tag(means: DataFrame, keys: Sequence[str], least: float = LEAST_SCORE, classes: Sequence[tuple[int, int]] = CLASS_PROGRAMS, column: str = "means") -> DataFrame:
    """(keys, class, score) of the best class that has a program; of equal ones the last in `classes`; no row where none reaches `least`.

    Scores are compared as the single floats that a model gives; classes beyond the list score 0.
    """
    options = F.array(*[F.struct(F.coalesce(F.get(column, F.lit(c)).cast("float"), F.lit(0.0).cast("float")).alias("score"), F.lit(k).alias("ord"), F.lit(c).alias("class")) for k, (c, _) in enumerate(classes)])
    best = F.array_max(F.filter(options, lambda x: x["score"] >= F.lit(least).cast("float")))
    return means.withColumn("_best", best).filter("_best IS NOT NULL").select(*keys, F.col("_best.class").alias("class"), F.col("_best.score").cast("double").alias("score"))


def tags(patches: DataFrame, keys: Sequence[str], least: float = LEAST_SCORE) -> DataFrame:
    """(keys, class, score) of stems from their raw patches."""
    return best_tag(pooled(patches, keys), keys, least)

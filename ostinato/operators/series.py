"""Operators over series of frames: energy, flux, thresholds, peaks, spacing, periods and filters.

Each takes a DataFrame, the key columns of a series and its order column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, half_up, tempo_weight
from . import ranges
from .scan import ordered


def by(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def frame_energy(df: DataFrame, keys: Sequence[str], frame: Column, value: str, name: str = "frame") -> DataFrame:
    """Root mean square of the values in each frame."""
    return df.groupBy(*keys, frame.alias(name)).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("energy"))


def hopping(df: DataFrame, index: str, size: int, hop: int, name: str = "frame") -> DataFrame:
    """Each row once for every frame [f * hop, f * hop + size) with f >= 0 that holds its index."""
    first = F.greatest(F.lit(0), F.floor((F.col(index) - size) / hop) + 1)
    return df.withColumn(name, F.explode(F.sequence(first.cast("long"), F.floor(F.col(index) / hop).cast("long"))))


def flux(df: DataFrame, keys: Sequence[str], order: str, value: str = "energy") -> DataFrame:
    """The rise of a series from row to row, 0 where it falls and at its start."""
    rise = F.col(value) - F.lag(value).over(by(keys, order))
    return df.withColumn("flux", F.coalesce(F.greatest(F.lit(0.0), rise), F.lit(0.0)))


def threshold(df: DataFrame, keys: Sequence[str], value: str = "flux", spread: float = 1.5) -> DataFrame:
    """The mean plus `spread` population deviations of each series, beside its rows."""
    w = Window.partitionBy(*keys)
    return df.withColumn("threshold", F.avg(value).over(w) + spread * F.stddev_pop(value).over(w))


def peaks(df: DataFrame, keys: Sequence[str], order: str, value: str = "flux", over: str = "threshold") -> DataFrame:
    """Inner rows above the threshold that no neighbour exceeds."""
    w = by(keys, order)
    around = df.withColumn("_before", F.lag(value).over(w)).withColumn("_after", F.lead(value).over(w))
    return around.filter((F.col(value) > F.col(over)) & (F.col(value) >= F.col("_before")) & (F.col(value) >= F.col("_after"))).drop("_before", "_after")


def strict_peaks(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Inner rows above both neighbours; the ends of a series are none."""
    w = by(keys, order)
    around = df.withColumn("_before", F.lag(value).over(w)).withColumn("_after", F.lead(value).over(w))
    return around.filter((F.col(value) > F.col("_before")) & (F.col(value) > F.col("_after"))).drop("_before", "_after")


def _kept(last, own: np.ndarray, gap) -> np.ndarray:
    """Places of the values that stand at least `gap` after the last one kept."""
    kept = []
    at = 0 if last is None else int(np.searchsorted(own, last + gap))
    while at < len(own):
        kept.append(at)
        at = max(at + 1, int(np.searchsorted(own, own[at] + gap)))
    return np.array(kept, np.int64)


def exits(own: np.ndarray, gap) -> tuple[np.ndarray, np.ndarray]:
    """What a stretch of sorted values keeps last, by where it is entered: (entries up to, last kept).

    Each value leads to the first one `gap` behind it; ways are doubled until all have reached the
    last value of theirs.  A stretch is entered within `gap` of its first value, so only those count, and
    neighbours with one end are one entry.
    """
    n = len(own)
    onward = np.maximum(np.searchsorted(own, own + gap), np.arange(n) + 1)
    way = np.where(onward < n, onward, np.arange(n))
    while True:
        further = way[way]
        if (further == way).all():
            break
        way = further
    some = way[: int(np.searchsorted(own, own[0] + gap, "right")) + 1]
    ends = np.flatnonzero(np.append(some[1:] != some[:-1], True))
    return own[ends], own[some[ends]]


def _long_spacing(own: DataFrame, keys: Sequence[str], x: str, gap: int) -> DataFrame:
    """Spacing of series of any length: each range says where it leaves to for each way in, and only that is folded in order."""
    rows = ranges.cut(own.distinct(), keys, [x])
    kind = own.schema[x].dataType.simpleString()
    kinds = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys)

    def described(group: pa.Table) -> pa.Table:
        values = np.sort(group.column(x).to_numpy())
        entry, end = exits(values, gap)
        first = [group.column(k)[:1] for k in (*keys, ranges.RANGE)]
        return pa.table([*first, pa.array([entry]), pa.array([end]), pa.array(values[-1:])], names=[*keys, ranges.RANGE, "entry", "end", "top"])

    def folded(group: pa.Table) -> pa.Table:
        group, last, found = group.sort_by(ranges.RANGE), None, []
        for entry, end, top in zip(group.column("entry"), group.column("end"), group.column("top"), strict=True):
            found.append(last)
            entry, end = entry.values.to_numpy(), end.values.to_numpy()
            if last is None:
                last = end[0]
            elif last + gap <= top.as_py():
                last = end[int(np.searchsorted(entry, last + gap))]
        return pa.table([*(group.column(k) for k in (*keys, ranges.RANGE)), pa.array(found, group.schema.field("top").type)], names=[*keys, ranges.RANGE, "_last"])

    ways = rows.groupBy(*keys, ranges.RANGE).applyInArrow(described, f"{kinds}, {ranges.RANGE} int, entry array<{kind}>, end array<{kind}>, top {kind}")
    # a row of a range has as many numbers as values lie within one gap, however many rows it stands for
    entered = ways.groupBy(*keys).applyInArrow(folded, f"{kinds}, {ranges.RANGE} int, _last {kind}")

    def each(last, columns: list[np.ndarray]) -> tuple[object, np.ndarray, list[np.ndarray]]:
        own, first = columns
        last = last if last is not None else None if np.isnan(first[0]) else first[0]
        kept = _kept(last, own, gap)
        return (own[kept[-1]] if len(kept) else last), kept, [own[kept]]

    met = ranges.given(rows, entered, keys).withColumn("_last", F.coalesce(F.col("_last").cast("double"), F.lit(float("nan"))))
    return ordered(met, [*keys, ranges.RANGE], [x], [x, "_last"], f"{x} {kind}", each).drop(ranges.RANGE)


def spacing(df: DataFrame, keys: Sequence[str], x: str, gap: int, whole_rows: int | None = ranges.WHOLE_ROWS) -> DataFrame:
    """(keys, x) of the values that stand at least `gap` after the last one kept; repeated values count once.

    What is kept depends on what was kept before, so a series is folded in order, from one kept
    value to the next.  Series of more than `whole_rows` rows are folded by ranges instead; None saves
    the count where series are known to be short.
    """

    def each(last, columns: list[np.ndarray]) -> tuple[object, np.ndarray, list[np.ndarray]]:
        own = columns[0]
        kept = _kept(last, own, gap)
        return (own[kept[-1]] if len(kept) else last), kept, [own[kept]]

    own = df.filter(F.col(x).isNotNull()).select(*keys, x)
    shape = f"{x} {df.schema[x].dataType.simpleString()}"
    long = ranges.long_keys(ranges.counted(own, keys), keys, whole_rows) if whole_rows is not None else None
    if long is None:
        return ordered(own, keys, [x], [x], shape, each)
    short, rest = ranges.split(own, keys, long)
    return ordered(short, keys, [x], [x], shape, each).unionByName(_long_spacing(rest, keys, x, gap))


def merge_onsets(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str, gap: int, whole_rows: int | None = ranges.WHOLE_ROWS) -> DataFrame:
    """The distinct union of two onset lists, spaced again."""
    return spacing(a.select(*keys, x).unionByName(b.select(*keys, x)), keys, x, gap, whole_rows)


def inferred_onsets(df: DataFrame, keys: Sequence[str], order: str, onset: str, value: str) -> DataFrame:
    """Onsets raised to the scaled rise of the values: the least rise over one and two rows, 0 in the first two."""
    w = by(keys, order)
    rise = F.greatest(F.lit(0.0), F.least(F.col(value) - F.lag(value, 1).over(w), F.col(value) - F.lag(value, 2).over(w)))
    risen = df.withColumn("rise", F.when(F.lag(value, 2).over(w).isNotNull(), rise).otherwise(0.0))
    every = Window.partitionBy(*keys)  # the same partitions, so nothing is shuffled again
    risen = risen.withColumn("_top", F.max(onset).over(every)).withColumn("_most", F.max("rise").over(every))
    scaled = F.when(F.col("_most") > 0, F.col("rise") * F.col("_top") / F.col("_most")).otherwise(0.0)
    return risen.withColumn("inferred", F.greatest(F.col(onset), scaled)).drop("_top", "_most")


def autocorrelation(df: DataFrame, keys: Sequence[str], order: str, value: str, low: int, high: int, block: int = 1 << 14) -> DataFrame:
    """(keys, lag, score): sums of products of rows `lag` apart, for each lag from low to high.

    Places are cut in blocks of `block` frames; the first `high` frames of a block also go to the one
    before, so blocks are independent and a long series is many tasks.  In a block each lag is one
    look-up of sorted places and one product of arrays.
    """
    own = F.floor(F.col(order) / block).cast("long")
    # a block needs what lies up to `high` frames ahead of its own rows
    first = F.floor((F.col(order) - high) / block).cast("long")
    rows = df.select(*keys, order, F.col(value).cast("double").alias("_v"), own.alias("_own"), F.explode(F.sequence(first, own)).alias("_block"))
    lags = np.arange(low, high + 1)

    def each(state, columns: list[np.ndarray]) -> tuple[object, np.ndarray, list[np.ndarray]]:
        at, x, inside = columns
        at, mine = at.astype(np.int64), inside.astype(bool)
        if state is not None:  # the block's earlier rows that may still have partners
            at, x, mine = np.concatenate([state[0], at]), np.concatenate([state[1], x]), np.concatenate([state[2], mine])
        fresh = len(at) - len(columns[0])
        sums, n = np.zeros(len(lags)), np.zeros(len(lags), bool)
        for k, lag in enumerate(lags.tolist()):
            place = np.searchsorted(at, at[fresh:] - lag)  # each new row with the one `lag` before it
            met = (at[place] == at[fresh:] - lag) & mine[place]
            sums[k], n[k] = x[place[met]] @ x[fresh:][met], met.any()
        tail = at >= at[-1] - high
        return (at[tail], x[tail], mine[tail]), np.zeros(int(n.sum()), np.int64), [lags[n].astype(np.int32), sums[n]]

    met = ordered(rows.withColumn("_mine", F.col("_own") == F.col("_block")), [*keys, "_block"], [order], [order, "_v", "_mine"], "lag int, score double", each)
    return met.groupBy(*keys, "lag").agg(F.sum("score").alias("score"))


def tempo(df: DataFrame, keys: Sequence[str], order: str, value: str = "flux", rate: float = 86.1328125, least: float = 60.0, most: float = 200.0, default: int = 120) -> DataFrame:
    """(keys, best_lag, bpm) of each series of flux at `rate` frames a second.

    The lag with the highest weighted correlation wins (the shortest of equal ones), unless the lag
    two thirds as long correlates at least 0.6 times as much; a parabola through its neighbours
    refines it.  Series that are silent or too short get the default.
    """
    low, high = int(rate * 60 / most), int(rate * 60 / least)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"))
    biased = F.col("score") * tempo_weight(F.lit(60.0 * rate) / F.col("lag"))
    # a row of a series has at most high - low + 1 lags
    lags = autocorrelation(df, keys, order, value, low, high).groupBy(*keys).agg(F.collect_list(F.struct(biased.alias("biased"), (-F.col("lag")).alias("back"), "lag", "score")).alias("_lags"))
    one = lambda name, lag: F.get(F.transform(F.filter("_lags", lambda x: x["lag"] == lag), lambda x: x[name]), F.lit(0))
    top = lags.withColumn("_top", F.array_max("_lags"))
    short = half_up(F.col("_top.lag") / 1.5)
    picked = top.withColumn("best_lag", F.when(F.coalesce(one("score", short) >= 0.6 * F.col("_top.score"), F.lit(False)), short).otherwise(F.col("_top.lag")).cast("int"))
    near = picked.select(*keys, "best_lag", *[F.coalesce(one("biased", F.col("best_lag") + step), F.lit(0.0)).alias(name) for step, name in ((-1, "_a"), (0, "_b"), (1, "_c"))])
    bend = F.col("_a") - 2 * F.col("_b") + F.col("_c")
    shift = F.when((F.col("best_lag") > 1) & (bend != 0), 0.5 * (F.col("_a") - F.col("_c")) / bend).otherwise(0.0)
    found = near.select(*keys, "best_lag", half_up(clip(F.lit(60.0 * rate) / (F.col("best_lag") + shift), least, most)).cast("int").alias("_bpm"))
    usable = (F.col("_n") >= 8) & (F.col("_sum") > 1e-9)
    return sizes.join(found, list(keys), "left").select(*keys, F.when(usable, F.col("best_lag")).alias("best_lag"), F.when(usable, F.coalesce("_bpm", F.lit(default))).otherwise(default).alias("bpm"))


def zero_crossing(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Share of neighbours with different signs (zero counts as positive); 0 for fewer than two rows."""
    sign = F.col(value) >= 0
    steps = df.select(*keys, (sign != F.lag(sign).over(by(keys, order))).alias("_turn"))
    return steps.groupBy(*keys).agg(F.when(F.count("*") > 1, F.count_if("_turn") / (F.count("*") - 1)).otherwise(0.0).alias("zcr"))


def one_pole(df: DataFrame, keys: Sequence[str], order: str, value: str, alpha: float, block: int = 128, whole_rows: int = ranges.WHOLE_ROWS) -> DataFrame:
    """(keys, order, smooth): y += alpha * (x - y) from y = 0, in order.

    A series passes through one task in batches, and only its last y is carried on.  Inside a block
    all y are one product with the weights of what came before, so time grows with the length.
    Series of more than `whole_rows` rows are cut at ranges: what comes into a range is the last y of the
    one before, and goes out times (1 - alpha) to the number of its rows, plus what it has by itself.
    """
    steps = np.arange(block)
    decay = (1 - alpha) ** (steps + 1)
    weights = np.tril(alpha * (1 - alpha) ** np.maximum(steps[:, None] - steps[None, :], 0))

    def each(y, columns: list[np.ndarray]) -> tuple[object, np.ndarray, list[np.ndarray]]:
        own, x = columns[0], columns[1].astype(np.float64)
        smooth, y = np.empty(len(x)), (float(columns[2][0]) if len(columns) > 2 else 0.0) if y is None else y
        for at in range(0, len(x), block):
            n = min(block, len(x) - at)
            smooth[at : at + n] = weights[:n, :n] @ x[at : at + n] + decay[:n] * y
            y = float(smooth[at + n - 1])
        return y, np.arange(len(x)), [own, smooth]

    def carried(y, columns: list[np.ndarray]) -> tuple[object, np.ndarray, list[np.ndarray]]:
        y, found = 0.0 if y is None else y, np.empty(len(columns[0]))
        for k, (n, end) in enumerate(zip(columns[1].tolist(), columns[2].tolist(), strict=True)):
            found[k] = y
            y = end + (1 - alpha) ** n * y
        return y, np.arange(len(found)), [columns[0], found]

    own = df.select(*keys, order, F.col(value).cast("double").alias("_x"))
    shape = f"{order} {df.schema[order].dataType.simpleString()}, smooth double"
    long = ranges.long_keys(ranges.counted(own, keys), keys, whole_rows)
    if long is None:
        return ordered(own, keys, [order], [order, "_x"], shape, each)
    short, rest = ranges.split(own, keys, long)
    rows, part = ranges.cut(rest, keys, [order]), [*keys, ranges.RANGE]
    alone = ordered(rows, part, [order], [order, "_x"], shape, each)
    ends = alone.groupBy(*part).agg(F.count("*").alias("_n"), F.max_by("smooth", order).alias("_y"))
    entered = ordered(ends, keys, [ranges.RANGE], [ranges.RANGE, "_n", "_y"], f"{ranges.RANGE} int, _y0 double", carried)
    done = ordered(ranges.given(rows, entered, keys), part, [order], [order, "_x", "_y0"], shape, each).drop(ranges.RANGE)
    return ordered(short, keys, [order], [order, "_x"], shape, each).unionByName(done)


def resample(df: DataFrame, keys: Sequence[str], index: str, value: str, source: int, target: int) -> DataFrame:
    """(keys, out, value): linear interpolation of a series 0 ... n - 1 at another rate; the last value is held.

    Each input row emits the outputs between itself and its right neighbour, so no join is needed.
    """
    w = by(keys, index)
    rows = df.select(*keys, F.col(index).cast("long").alias("_i"), F.col(value).alias("_v"), F.lead(value).over(w).alias("_next"))
    sizes = df.groupBy(*keys).agg((F.floor(F.count("*") * target / source)).cast("long").alias("_outs"))
    rows = rows.join(sizes, list(keys))
    first, last = F.ceil(F.col("_i") * target / source), F.least(F.ceil((F.col("_i") + 1) * target / source), F.col("_outs")) - 1
    rows = rows.withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long")).filter("_last >= _first")
    rows = rows.withColumn("out", F.explode(F.sequence("_first", "_last")))
    part = F.col("out") * source / target - F.col("_i")
    return rows.select(*keys, "out", (F.col("_v") + (F.coalesce("_next", "_v") - F.col("_v")) * part).alias(value))


def gap_runs(df: DataFrame, keys: Sequence[str], order: str, quiet: str, most: int) -> DataFrame:
    """(keys, begin, end, n) of runs of loud rows that go on through at most `most` quiet places between loud ones."""
    loud = df.filter(f"NOT ({quiet})").select(*keys, F.col(order).alias("_x"))
    w = by(keys, "_x")
    new = F.coalesce((F.col("_x") - F.lag("_x").over(w) > most + 1).cast("int"), F.lit(1))
    runs = loud.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("_x").alias("begin"), F.max("_x").alias("end"), F.count("*").alias("n")).drop("_run")

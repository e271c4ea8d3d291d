"""Joins in time and over ranges: as-of lookups, tempo maps, pairing and range matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def _united(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, seq: str | None) -> DataFrame:
    order = F.col(seq) if seq else F.lit(0)
    marks = right.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), order.cast("long").alias("_seq"), F.struct(F.col(value).alias("v")).alias("_mark"))
    rows = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_seq"), F.struct(*left.columns).alias("_row"))
    return marks.unionByName(rows, allowMissingColumns=True)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, seq: str | None = None, whole_rows: int | None = ranges.WHOLE_ROWS) -> DataFrame:
    """left, and `value` of the last right row of its keys at or before `at` (of equal times the last by `seq`; null if none).

    One union and one window: rows are sorted once, and no pairs are made.  Keys of more than
    `whole_rows` rows on both sides are cut at ranges of time, and each range gets the last mark before it;
    None saves the count where keys are known to be short.
    """
    both = ranges.counted(left, keys).unionByName(ranges.counted(right, keys)) if whole_rows is not None else None
    return _as_of(left, right, keys, at, value, seq, ranges.long_keys(both, keys, whole_rows) if both is not None else None)


def _as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, seq: str | None, long: DataFrame | None) -> DataFrame:
    both, order = _united(left, right, keys, at, value, seq), ["_at", "_side", "_seq"]
    found = lambda df, by: df.withColumn("_found", F.last("_mark", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    done = lambda df: df.filter("_side = 1").select("_row.*", F.col("_found.v").alias(value))
    if long is None:
        return done(found(both, keys))
    short, rest = ranges.split(both, keys, long)
    rows = ranges.cut(rest, keys, order)
    newest = F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.struct("_at", "_seq")))
    rows = ranges.earlier(rows, keys, _carried=(newest, ranges.last))
    met = found(rows, [*keys, ranges.RANGE]).withColumn("_found", F.coalesce("_found", "_carried"))
    return done(found(short, keys)).unionByName(done(met))


def tempo_ms(events: DataFrame, changes: DataFrame, keys: Sequence[str], division: int | Column = 480, tick: str = "tick", micros: str = "micros", seq: str = "seq", start_micros: int = 500_000, whole_rows: int | None = ranges.WHOLE_ROWS) -> DataFrame:
    """events with `ms`: whole milliseconds of each tick over the tempo changes of its keys (of changes at one tick the last holds).

    Keys of more than `whole_rows` rows on both sides have their sums taken over ranges of ticks, then inside them.
    """
    begin = events.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias(tick), F.lit(start_micros).cast("long").alias(micros), F.lit(-1).cast("long").alias(seq))
    every = begin.unionByName(changes.select(*keys, F.col(tick).cast("long"), F.col(micros).cast("long"), F.col(seq).cast("long")))

    part, order = [*keys, ranges.RANGE], [tick, seq]
    state = F.struct(F.col(tick).alias("t"), F.col(micros).alias("m"))

    def stepped(rows: DataFrame, by: Sequence[str], before: Column | None = None) -> DataFrame:
        """Changes with what has passed since the one before; the first of a range has its `before` from earlier ranges."""
        prior = F.lag(state).over(Window.partitionBy(*by).orderBy(*order))
        prior = prior if before is None else F.coalesce(prior, before)
        return rows.withColumn("_prior", prior).withColumn("_step", F.coalesce((F.col(tick) - F.col("_prior.t")) * F.col("_prior.m"), F.lit(0)))

    def summed(steps: DataFrame, by: Sequence[str], sums: Column) -> DataFrame:
        base = F.sum("_step").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + sums
        return steps.select(*keys, tick, seq, F.struct(F.col(tick).alias("t"), F.col(micros).alias("m"), base.alias("base")).alias("_state"))

    both = ranges.counted(events, keys).unionByName(ranges.counted(changes, keys)) if whole_rows is not None else None
    long = ranges.long_keys(both, keys, whole_rows) if both is not None else None
    if long is None:
        states = summed(stepped(every, keys), keys, F.lit(0))
    else:
        short, rest = ranges.split(every, keys, long)
        rows = ranges.earlier(ranges.cut(rest, keys, order), keys, _newest=(F.max_by(state, F.struct(*order)), ranges.last))
        steps = ranges.earlier(stepped(rows, part, F.col("_newest")), keys, _sums=(F.sum("_step"), F.sum))
        states = summed(stepped(short, keys), keys, F.lit(0)).unionByName(summed(steps, part, F.coalesce("_sums", F.lit(0))))
    found = _as_of(events, states, keys, tick, "_state", seq, long)
    total = (F.col("_state.base") + (F.col(tick) - F.col("_state.t")) * F.col("_state.m")) / 1000.0 / division
    return found.withColumn("ms", total.cast("long")).drop("_state")


def pair_oldest(ons: DataFrame, offs: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """(keys, on_at, off_at): the k-th end of a key closes its k-th start."""
    w = Window.partitionBy(*keys).orderBy(at)
    a = ons.select(*keys, F.col(at).alias("on_at"), F.row_number().over(w).alias("_k"))
    b = offs.select(*keys, F.col(at).alias("off_at"), F.row_number().over(w).alias("_k"))
    return a.join(b, [*keys, "_k"]).drop("_k")


def state_at(df: DataFrame, keys: Sequence[str], at: str, until) -> DataFrame:
    """The latest row of each key at or before a time; an aggregation that reduces before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    latest = df.filter(F.col(at) <= until).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(at)).alias("_row"))
    return latest.select(*keys, "_row.*")


def in_regions(points: DataFrame, regions: DataFrame, x: str, low: str, high: str, width: int, also: tuple[str, str, str] | None = None) -> DataFrame:
    """Every point with every region whose range [low, high] holds its x (and whose second range holds its y: also = (y, low, high)).

    Cells fit the ranges that there are: a range is dealt to cells of `width` times the power of two that
    reaches its length, so it touches two of them at most, however wide it is.  A point is dealt to its
    cell of each size that occurs, and the join hashes on size and cell in place of comparing all pairs.
    Ranges that end before they begin hold nothing.
    """
    span = (F.col(high) - F.col(low)) / width
    level = F.when(span <= 1, 0).otherwise(F.ceil(F.log2(span.cast("double")))).cast("int")
    sized = regions.filter(F.col(high) >= F.col(low)).withColumn("_level", level)
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())  # one of some sixty
    cell = lambda c, k: F.floor(F.col(c) / (width * F.pow(F.lit(2.0), k))).cast("long")
    spread = sized.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(low, F.col("_level")), cell(high, F.col("_level"))))))
    dealt = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    met = dealt.withColumn("_cell", cell(x, F.col("_level"))).join(spread, ["_level", "_cell"]).filter(F.col(x).between(F.col(low), F.col(high))).drop("_level", "_cell")
    return met.filter(F.col(also[0]).between(F.col(also[1]), F.col(also[2]))) if also else met


def peak_between(spans: DataFrame, points: DataFrame, keys: Sequence[str], begin: str, end: str, at: str, value: str, width: int) -> DataFrame:
    """spans with `peak`: the largest absolute value of the points of their keys in [begin, end), 0 for none.

    Time is cut into cells of `width`.  Cells that a span covers whole give it one number each, and
    only at its two ends it meets points, so long spans cost cells and not points.
    """
    own = [*keys, begin, end]
    cell = lambda c: F.floor(c / width).cast("long")
    placed = points.select(*keys, F.col(at).alias("_at"), F.abs(value).cast("double").alias("_v"), cell(F.col(at)).alias("_cell"))
    tops = placed.groupBy(*keys, "_cell").agg(F.max("_v").alias("_v"))
    wanted = spans.select(*own).distinct().filter(F.col(end) > F.col(begin)).withColumn("_cell", F.explode(F.sequence(cell(F.col(begin)), cell(F.col(end) - 1))))
    covered = (F.col("_cell") * width >= F.col(begin)) & ((F.col("_cell") + 1) * width <= F.col(end))
    inner = wanted.filter(covered).join(tops, [*keys, "_cell"]).select(*own, "_v")
    edges = wanted.filter(~covered).join(placed, [*keys, "_cell"]).filter((F.col("_at") >= F.col(begin)) & (F.col("_at") < F.col(end))).select(*own, "_v")
    found = inner.unionByName(edges).groupBy(*own).agg(F.max("_v").alias("_peak"))
    return spans.join(found, own, "left").withColumn("peak", F.coalesce("_peak", F.lit(0.0))).drop("_peak")


def sounding(events: DataFrame, channel: Sequence[str], note: str, at: Sequence[str], on: Column) -> DataFrame:
    """events with `sounding`: how many different notes of the channel sound after each event.

    It is a set: a start of a sounding note and an end of a silent one change nothing.
    """
    before = F.coalesce(F.lag(on.cast("int")).over(Window.partitionBy(*channel, note).orderBy(*at)), F.lit(0))
    steps = events.withColumn("_step", on.cast("int") - before)
    return steps.withColumn("sounding", F.sum("_step").over(Window.partitionBy(*channel).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0))).drop("_step")

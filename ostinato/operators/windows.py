"""Fixed windows of samples for models, and what goes back from windows of frames to one series.

Chunks are dealt to the windows that they overlap, and each window is put together in a row of
bounded size, so neither a whole signal nor its windows meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import EDGE_FRAMES, SAMPLE_RATE, WINDOW_FRAMES, WINDOW_HOP, WINDOW_LEAD, WINDOW_SAMPLES, frames_of

_PART = "array<struct<at:bigint,x:array<float>>>"


def _zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), F.greatest(n, F.lit(0)).cast("int"))


def _joined(parts: str, size: Column, end: Column) -> Column:
    """Samples of all parts in order, with zeros before the first and after `end` up to `size`."""
    inside = F.flatten(F.transform(F.array_sort(parts), lambda p: p["x"]))
    return F.concat(_zeros(F.array_min(F.transform(parts, lambda p: p["at"]))), inside, _zeros(size - end))


def fixed(pcm: DataFrame, keys: Sequence[str], size: int = WINDOW_SAMPLES, hop: int = WINDOW_HOP, lead: int = WINDOW_LEAD) -> DataFrame:
    """(keys, window_no, samples) of a mono signal: `size` samples from each `hop`, counted from `lead` zeros before it.

    The last window is filled up with zeros; a signal without samples has no windows.
    """
    begin = F.col("start").cast("long") + lead
    n = F.size("samples").cast("long")
    first = F.greatest(F.lit(0), F.floor((begin - size) / hop) + 1).cast("long")
    dealt = pcm.filter(F.size("samples") > 0).select(*keys, "samples", begin.alias("_begin"), n.alias("_n"), F.explode(F.sequence(first, F.floor((begin + n - 1) / hop).cast("long"))).alias("window_no"))
    at = F.col("window_no") * hop
    lo, hi = F.greatest(at, F.col("_begin")), F.least(at + size, F.col("_begin") + F.col("_n"))
    part = F.struct((lo - at).alias("at"), F.slice("samples", (lo - F.col("_begin") + 1).cast("int"), (hi - lo).cast("int")).alias("x"))
    whole = dealt.select(*keys, "window_no", part.alias("part"), (hi - at).alias("end")).groupBy(*keys, "window_no").agg(F.collect_list("part").cast(_PART).alias("parts"), F.max("end").alias("end"))
    return whole.select(*keys, "window_no", _joined("parts", F.lit(size), F.col("end")).alias("samples"))


def planar(pcm: DataFrame, places: DataFrame, keys: Sequence[str], segment: int, chunk: int, channels: int = 2) -> DataFrame:
    """(keys, offset, samples): the model's input at each of `overlap.placements`, one channel after another, `segment` samples each.

    What is read stands behind `pad_left` zeros, and zeros follow it.  All chunks but the last have `chunk` frames.
    """
    stop = F.col("read_start") + F.col("read_length")
    wanted = places.select(*keys, "offset", "read_start", "pad_left", stop.alias("_stop"), F.explode(F.sequence(F.floor(F.col("read_start") / chunk), F.floor((stop - 1) / chunk))).alias("chunk_no"))
    met = wanted.join(pcm.select(*keys, F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start").cast("long").alias("_begin"), "samples"), [*keys, "chunk_no"])
    lo, hi = F.greatest("read_start", "_begin"), F.least(F.col("_stop"), F.col("_begin") + F.size("samples") / channels).cast("long")
    at = lo - F.col("read_start") + F.col("pad_left")
    frames = F.slice("samples", ((lo - F.col("_begin")) * channels + 1).cast("int"), ((hi - lo) * channels).cast("int"))
    whole = met.select(*keys, "offset", F.struct(at.alias("at"), frames.alias("x")).alias("part"), (at + hi - lo).alias("end")).groupBy(*keys, "offset").agg(F.collect_list("part").cast(_PART).alias("parts"), F.max("end").alias("end"))
    inside = F.flatten(F.transform(F.array_sort("parts"), lambda p: p["x"]))
    whole = whole.select(*keys, "offset", "end", F.array_min(F.transform("parts", lambda p: p["at"])).alias("first"), inside.alias("x"))
    one = lambda c: F.concat(_zeros(F.col("first")), F.filter("x", lambda _, i: i % channels == c), _zeros(F.lit(segment) - F.col("end")))
    return whole.select(*keys, "offset", F.concat(*[one(c) for c in range(channels)]).alias("samples"))


def trimmed(rows: DataFrame, keys: Sequence[str], totals: DataFrame, window: str = "window_no", frame: str = "f", frames: int = WINDOW_FRAMES, edge: int = EDGE_FRAMES) -> DataFrame:
    """Rows of windows of `frames` frames as one series: without `edge` frames at both ends of each window, numbered on as `t`, and cut to `total` of the keys."""
    inner = frames - 2 * edge
    t = F.col(window).cast("long") * inner + F.col(frame) - edge
    rest = [c for c in rows.columns if c not in (*keys, window, frame)]
    kept = rows.filter(F.col(frame).between(edge, frames - edge - 1)).select(*keys, t.alias("t"), *rest)
    return kept.join(totals.select(*keys, F.col("total").alias("_total")), list(keys)).filter(F.col("t") < F.col("_total")).drop("_total")


def frame_totals(pcm: DataFrame, keys: Sequence[str], sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """(keys, total): how many activation frames a mono signal has."""
    return pcm.groupBy(*keys).agg(frames_of(F.sum(F.size("samples")), sample_rate).alias("total"))


def span_peaks(pcm: DataFrame, spans: DataFrame, keys: Sequence[str], begin: str, end: str, chunk: int) -> DataFrame:
    """spans with `peak`: the largest absolute sample of a mono signal in [begin, end), 0 for none.

    A span meets the chunks that it touches, and each gives one number before they meet again.
    All chunks but the last have `chunk` samples; rows of equal keys, begin and end are equal spans.
    """
    own = [*keys, begin, end]
    last = F.greatest(F.col(end) - 1, F.col(begin))
    dealt = spans.select(*own).distinct().filter(F.col(end) > F.col(begin)).withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col(begin) / chunk), F.floor(last / chunk))))
    met = dealt.join(pcm.select(*keys, F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start").cast("long").alias("_at"), "samples"), [*keys, "chunk_no"])
    lo = F.greatest(F.col(begin) - F.col("_at"), F.lit(0))
    n = F.least(F.col(end) - F.col("_at"), F.size("samples")) - lo
    piece = F.slice("samples", (lo + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))
    found = met.select(*own, F.array_max(F.transform(piece, F.abs)).cast("double").alias("_peak")).groupBy(*own).agg(F.max("_peak").alias("_peak"))
    return spans.join(found, own, "left").withColumn("peak", F.coalesce("_peak", F.lit(0.0))).drop("_peak")

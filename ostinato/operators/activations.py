"""Notes from matrices of note and onset activations.

A stem's matrix has a row for each frame: (keys, t, frame array<float>, onset array<float>).
Decoding takes notes from a residual that each note changes for its neighbours.  A note ends before
eleven quiet frames, so none crosses a longer silence: stems of many frames are cut there, and their
pieces decoded apart, with the scale of the whole stem.  Others are one group each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from . import joins, ranges

LOWEST_PITCH, QUIET_FRAMES = 21, 11


#: A silence of so many frames is cut in its middle: a note that begins in it, and what it silences around itself, stays on its side.
CUT_FRAMES = 2 * QUIET_FRAMES + 6
#: Frames of a stem that one task decodes whole (over an hour and a half).
WHOLE_FRAMES = 500_000


def risen(frame: np.ndarray) -> np.ndarray:
    """The rise of frames over one and two steps, 0 for the first two."""
    rise = np.zeros_like(frame)
    if len(frame) > 2:
        rise[2:] = np.maximum(0, np.minimum(frame[2:] - frame[1:-1], frame[2:] - frame[:-2]))
    return rise


def inferred(onset: np.ndarray, frame: np.ndarray, tops: tuple[float, float] | None = None) -> np.ndarray:
    """Onsets raised to the scaled rise of the frames; `tops` are the largest onset and rise, where these are a part of a stem."""
    rise = risen(frame)
    most, top = tops if tops is not None else (onset.max(initial=0), rise.max(initial=0))
    return np.maximum(onset, rise * (np.float32(most) / np.float32(top))) if top > 0 else onset


def _reach(loud: np.ndarray, limit: int) -> int:
    """How many of the values ahead a note takes: up to the last loud one before `limit` quiet ones in a row."""
    at = np.flatnonzero(loud)
    if not len(at) or at[0] >= limit:
        return 0
    wide = np.flatnonzero(np.diff(at) > limit)
    return int(at[wide[0]] if len(wide) else at[-1]) + 1


def decode(frame: np.ndarray, onset: np.ndarray, frame_least: float = 0.3, onset_least: float = 0.5, leftover: bool = True, tops: tuple[float, float] | None = None, halo: int = 0) -> list[tuple[int, int, int, float]]:
    """(start, end, pitch, amplitude) by start; `leftover` also takes notes without an onset from what remains.

    The first `halo` rows only serve the rise of those behind them, and places count from there.
    """
    full = inferred(onset, frame, tops)[halo:] if frame.ndim == 2 and len(frame) else onset
    frame = frame[halo:]
    n, bins = frame.shape if frame.ndim == 2 else (0, 0)
    if n < 3:
        return []
    rest = frame.copy()
    peak = np.zeros_like(full, bool)
    peak[1:-1] = (full[1:-1] > full[:-2]) & (full[1:-1] > full[2:])
    times, pitches = np.nonzero(peak & (full >= onset_least))
    notes = []
    for t, f in zip(times[::-1].tolist(), pitches[::-1].tolist(), strict=True):  # late first, then high
        if t >= n - 1:
            continue
        end = t + 1 + _reach(rest[t + 1 : n - 1, f] >= frame_least, QUIET_FRAMES)
        if end - t <= QUIET_FRAMES:
            continue
        rest[t:end, max(0, f - 1) : f + 2] = 0
        notes.append((t, end, f + LOWEST_PITCH, float(frame[t:end, f].mean())))
    tops = rest.max(1)  # of each row, so that a turn looks at changed rows only
    while leftover and tops.max() > frame_least:
        t = int(tops.argmax())
        f = int(rest[t].argmax())
        rest[t, f] = 0
        ahead, behind = rest[t + 1 : n - 1, f] >= frame_least, rest[1:t, f][::-1] >= frame_least
        near = slice(max(0, f - 1), f + 2)
        seen = min(len(ahead), _reach(ahead, QUIET_FRAMES) + QUIET_FRAMES)
        back = min(len(behind), _reach(behind, QUIET_FRAMES) + QUIET_FRAMES)
        end, start = t + _reach(ahead, QUIET_FRAMES), t - _reach(behind, QUIET_FRAMES)
        rest[t + 1 : t + 1 + seen, near] = 0
        rest[t - back : t, near] = 0
        tops[t - back : t + 1 + seen] = rest[t - back : t + 1 + seen].max(1)
        if end - start > QUIET_FRAMES:
            notes.append((start, end, f + LOWEST_PITCH, float(frame[start:end, f].mean())))
    return sorted(notes)


def _matrix(group: pa.Table, name: str, order: np.ndarray) -> np.ndarray:
    """A list column as rows of numbers, read from its flat values."""
    column = group.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1)[order] if len(column) else np.zeros((0, 0), np.float32)


def _pieces(matrix: DataFrame, keys: Sequence[str], frame_least: float, whole_rows: int) -> DataFrame:
    """(keys, t, _piece): the piece of each row, named by its first frame; the last two rows before a piece also belong to it.

    Only places and whether they sound are put in order; of long stems by ranges (`as_of`).
    """
    light = matrix.select(*keys, F.col("t").cast("long").alias("t"), (F.array_max("frame") >= F.lit(frame_least).cast("float")).alias("_loud"))
    before = F.lag("t").over(Window.partitionBy(*keys).orderBy("t"))
    gap = F.col("t") - F.col("_before")
    cuts = light.filter("_loud").withColumn("_before", before).filter(gap > CUT_FRAMES).select(*keys, (F.col("_before") + F.floor(gap / 2)).cast("long").alias("t"))
    cuts = cuts.withColumn("_cut", F.struct(F.col("t").alias("at"), F.lag("t").over(Window.partitionBy(*keys).orderBy("t")).alias("earlier")))
    ahead = joins.as_of(light.select(*keys, (F.col("t") + 2).alias("t")), cuts, keys, "t", "_cut", whole_rows=whole_rows).withColumn("t", F.col("t") - 2)
    first, at = F.lit(-(2**62)), F.col("_cut.at")
    own = F.when(at <= F.col("t"), at).otherwise(F.coalesce("_cut.earlier", first))
    both = F.when(at > F.col("t"), F.array(own, at)).otherwise(F.array(F.coalesce(own, first)))
    return ahead.select(*keys, "t", F.explode(both).alias("_piece"))


def notes(matrix: DataFrame, keys: Sequence[str], frame_least: float = 0.3, onset_least: float = 0.5, leftover: bool = True, whole_frames: int = WHOLE_FRAMES) -> DataFrame:
    """(keys, start_frame, end_frame, pitch, amplitude) of each stem.

    Stems of more than `whole_frames` frames are decoded in pieces between silences, whatever
    their length; a stretch without a silence of `CUT_FRAMES` frames is one piece.
    """
    kinds = ", ".join(f"{k} {matrix.schema[k].dataType.simpleString()}" for k in keys)
    shape = f"{kinds}, start_frame int, end_frame int, pitch int, amplitude double"

    def table(group: pa.Table, found: list[tuple[int, int, int, float]]) -> pa.Table:
        own = {k: pa.array([group.column(k)[0].as_py()] * len(found), group.schema.field(k).type) for k in keys}
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        made = {name: pa.array(x, kind) for name, x, kind in zip(("start_frame", "end_frame", "pitch", "amplitude"), columns, (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)}
        return pa.table(own | made)

    def whole(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("t").to_numpy(), kind="stable")
        return table(group, decode(_matrix(group, "frame", order), _matrix(group, "onset", order), frame_least, onset_least, leftover))

    def tops(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("t").to_numpy(), kind="stable")
        rise = risen(_matrix(group, "frame", order))
        own = {k: group.column(k)[:1] for k in keys}
        return pa.table(own | {"_onset": pa.array([float(_matrix(group, "onset", order).max(initial=0))]), "_rise": pa.array([float(rise.max(initial=0))])})

    def piece(group: pa.Table) -> pa.Table:
        t = group.column("t").to_numpy()
        order = np.argsort(t, kind="stable")
        t, halo = t[order], int((t < group.column("_piece")[0].as_py()).sum())
        scale = group.column("_onset")[0].as_py(), group.column("_rise")[0].as_py()
        found = decode(_matrix(group, "frame", order), _matrix(group, "onset", order), frame_least, onset_least, leftover, scale, halo)
        first = int(t[halo]) if halo < len(t) else 0
        return table(group, [(a + first, b + first, p, v) for a, b, p, v in found])

    own = matrix.select(*keys, F.col("t").cast("long").alias("t"), "frame", "onset")
    long = ranges.long_keys(ranges.counted(own, keys), keys, whole_frames)
    if long is None:
        return own.groupBy(*keys).applyInArrow(whole, shape)
    short, rest = ranges.split(own, keys, long)
    named = _pieces(rest, keys, frame_least, whole_frames).withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"t": "_t"})
    same = F.col("t") == F.col("_t")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    parts = written(rest.join(named, same).select(*keys, "_piece", "t", "frame", "onset"))
    scale = parts.groupBy(*keys, "_piece").applyInArrow(tops, f"{kinds}, _onset double, _rise double").groupBy(*keys).agg(F.max("_onset").alias("_onset"), F.max("_rise").alias("_rise"))
    scale = scale.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    alike = F.lit(True)
    for k in keys:
        alike = alike & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    done = parts.join(scale, alike).select(*keys, "_piece", "t", "frame", "onset", "_onset", "_rise").groupBy(*keys, "_piece").applyInArrow(piece, shape)
    return short.groupBy(*keys).applyInArrow(whole, shape).unionByName(done)

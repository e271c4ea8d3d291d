"""Separation around a model: overlapping slices of a signal for it, and its outputs blended to stems.

A model takes slices of `segment` frames, one channel after another, and gives `sources` times as many
samples.  Slices are put together from the chunks that they touch; outputs are cut at chunks of the
result, and the few slices that say something about a chunk meet there as arrays.  No task holds more
than a slice's output, and no sample is a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .overlap import stride_of

# fixed values: what the model was made for
SAMPLE_RATE, CHANNELS, SEGMENT, OVERLAP = 44_100, 2, 343_980, 0.25
SOURCES = ("drums", "bass", "other", "vocals", "guitar", "piano")


def triangle(segment: int, power: float = 1.0) -> np.ndarray:
    """The weight of each place of a segment; rises to 1 in the middle."""
    half, place = segment // 2, np.arange(segment)
    return (np.where(place < half, place + 1, segment - place) / max(half, segment - half)) ** power


def totals(pcm: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, total): how many frames each signal has; those without frames are left out."""
    return pcm.groupBy(*keys).agg(F.sum(F.floor(F.size("samples") / F.col("channels"))).cast("long").alias("total")).filter("total > 0")


def _window(offset: Column, total: Column, segment: int) -> tuple[Column, Column, Column]:
    """(first frame, last + 1, frames in front) of what a slice reads: a short last one is read in the middle of a segment."""
    lead = F.floor((F.lit(segment) - F.least(F.lit(segment), total - offset)) / 2).cast("long")
    return F.greatest(F.lit(0).cast("long"), offset - lead), F.least(total, offset - lead + segment), F.greatest(F.lit(0).cast("long"), lead - offset)


def _arrays(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    """The values of a list column, a view for each row."""
    own = batch.column(column)
    flat, at = own.values.to_numpy(zero_copy_only=False), own.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _list(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.float32), *rows]).astype(np.float32)))


def slices(pcm: DataFrame, keys: Sequence[str], segment: int = SEGMENT, overlap: float = OVERLAP, channels: int = CHANNELS) -> DataFrame:
    """(keys, offset, total, samples): the model's input at each stride of a signal of `channels` channels; chunks may have any length.

    Frames are dealt to the slices that read them by arithmetic on `start`, so only the length of a signal is joined.
    """
    stride = stride_of(segment, overlap)
    begin, n = F.col("start").cast("long"), F.floor(F.size("samples") / channels).cast("long")
    rows = pcm.join(totals(pcm, keys), list(keys)).select(*keys, "samples", "total", begin.alias("_b"), (begin + n).alias("_e")).filter("_e > _b")
    # a slice reads at most a segment from its offset on, or, near the end, half a segment before it
    first = F.greatest(F.lit(0), F.floor((F.col("_b") - segment) / stride)).cast("long")
    last = F.least(F.floor((F.col("total") - 1) / stride), F.floor((F.col("_e") + segment // 2 + 1) / stride)).cast("long")
    dealt = rows.withColumn("offset", F.explode(F.transform(F.sequence(first, last), lambda k: k * stride)))
    lo, hi, front = _window(F.col("offset"), F.col("total"), segment)
    dealt = dealt.withColumn("_lo", F.greatest(lo, F.col("_b"))).withColumn("_hi", F.least(hi, F.col("_e"))).filter("_hi > _lo")
    piece = F.slice("samples", ((F.col("_lo") - F.col("_b")) * channels + 1).cast("int"), ((F.col("_hi") - F.col("_lo")) * channels).cast("int"))
    part = F.struct((F.col("_lo") - lo + front).cast("int").alias("at"), piece.alias("x"))
    whole = dealt.select(*keys, "offset", "total", part.alias("p")).groupBy(*keys, "offset", "total").agg(F.collect_list("p").alias("p"))
    whole = whole.select(*keys, "offset", "total", F.transform("p", lambda p: p["at"]).alias("at"), F.transform("p", lambda p: F.size(p["x"])).alias("n"), F.flatten(F.transform("p", lambda p: p["x"])).alias("x"))
    width = len(keys) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (at, sizes, x) in enumerate(zip(_arrays(batch, width), _arrays(batch, width + 1), _arrays(batch, width + 2), strict=True)):
                planar, used = np.zeros((channels, segment), np.float32), 0
                for a, size in zip(at.tolist(), sizes.tolist(), strict=True):
                    planar[:, a : a + size // channels] = x[used : used + size].reshape(-1, channels).T
                    used += size
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:width]), _list([planar.ravel()])], names=[*batch.schema.names[:width], "samples"])

    kinds = ", ".join(f"{k} {pcm.schema[k].dataType.simpleString()}" for k in keys)
    return whole.mapInArrow(run, f"{kinds}, offset long, total long, samples array<float>")


def blended(outputs: DataFrame, keys: Sequence[str], labels: Sequence[str] = SOURCES, segment: int = SEGMENT, channels: int = CHANNELS, chunk: int = 1 << 16, sample_rate: int = SAMPLE_RATE, power: float = 1.0) -> DataFrame:
    """Chunks of all stems, as pcm with `stem`, from (keys, offset, total, output): the weighted mean of what slices say about a frame.

    An output is flat: a source after another, and in each a channel after another.  One of another
    length fails the query, as its places would be wrong.  Sums are taken in the order of offsets.
    """
    weight = triangle(segment, power)
    width, size = len(keys) + 2, len(labels) * channels * segment
    own = ", ".join(f"{k} {outputs.schema[k].dataType.simpleString()}" for k in keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x in enumerate(_arrays(batch, width)):
                offset, total = batch.column(width - 2)[k].as_py(), batch.column(width - 1)[k].as_py()
                if len(x) != size:
                    raise ValueError(f"the model gave {len(x)} samples in place of {size}")
                valid = min(segment, total - offset)
                trim = (segment - valid) // 2
                x = x.reshape(len(labels), channels, segment)[:, :, trim : trim + valid]
                for c in range(offset // chunk, (offset + valid - 1) // chunk + 1):
                    lo, hi = max(offset, c * chunk), min(offset + valid, (c + 1) * chunk)
                    parts = [np.ascontiguousarray(s[:, lo - offset : hi - offset].T).ravel() for s in x]
                    at = pa.array([k] * len(labels))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(j).take(at) for j in range(width)), pa.array(list(labels)), pa.array([c] * len(labels), pa.int64()), pa.array([lo] * len(labels), pa.int64()), _list(parts)],
                        names=[*batch.schema.names[:width], "stem", "chunk_no", "from", "x"],
                    )

    pieces = outputs.select(*keys, "offset", "total", "output").mapInArrow(cut, f"{own}, offset long, total long, stem string, chunk_no long, from long, x array<float>")
    group = [*keys, "stem", "chunk_no", "total"]
    # a frame is in as many slices as strides fit a segment, so these lists are short
    met = pieces.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("offset", "from", "x"))).alias("p"))
    met = met.select(*group, F.col("p.offset").alias("offset"), F.col("p.from").alias("from"), F.transform("p", lambda p: F.size(p["x"])).alias("n"), F.flatten("p.x").alias("x"))
    wide = len(group)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = zip(*(_arrays(batch, wide + j) for j in range(4)), strict=True)
            for k, (offsets, froms, sizes, x) in enumerate(lists):
                c, total = batch.column(wide - 2)[k].as_py(), batch.column(wide - 1)[k].as_py()
                frames, used = min(chunk, total - c * chunk), 0
                sums, weights = np.zeros((frames, channels)), np.zeros(frames)
                for offset, lo, n in zip(offsets.tolist(), froms.tolist(), sizes.tolist(), strict=True):
                    trim = (segment - min(segment, total - offset)) // 2
                    w = weight[trim + lo - offset : trim + lo - offset + n // channels]
                    at = slice(lo - c * chunk, lo - c * chunk + len(w))
                    sums[at] += x[used : used + n].reshape(-1, channels) * w[:, None]
                    weights[at] += w
                    used += n
                blend = (sums / np.maximum(weights, 1e-8)[:, None]).astype(np.float32).ravel()
                columns = [*(batch.column(j).slice(k, 1) for j in range(wide - 1)), pa.array([c * chunk], pa.int64()), pa.array([sample_rate], pa.int32()), pa.array([channels], pa.int32()), _list([blend])]
                yield pa.RecordBatch.from_arrays(columns, names=[*group[:-1], "start", "sample_rate", "channels", "samples"])

    return met.mapInArrow(add, f"{own}, stem string, chunk_no long, start long, sample_rate int, channels int, samples array<float>")


def separated(pcm: DataFrame, model: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("track_id",), labels: Sequence[str] = SOURCES, segment: int = SEGMENT, overlap: float = OVERLAP, channels: int = CHANNELS, chunk: int = 1 << 16, sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """pcm with `stem`: `model` gets (keys, offset, total, samples) and returns (keys, offset, total, output).

    `pcm` must have the rate and the channels that the model wants, in chunks of any length.
    """
    return blended(model(slices(pcm, keys, segment, overlap, channels)), keys, labels, segment, channels, chunk, sample_rate)


def each_slice(run: Callable[[np.ndarray], np.ndarray], keys: Sequence[str] = ("track_id",), channels: int = CHANNELS) -> Callable[[DataFrame], DataFrame]:
    """A model for `separated` from a function of one slice: (channels, segment) -> (sources, channels, segment)."""

    def model(rows: DataFrame) -> DataFrame:
        width = len(keys) + 2

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, x in enumerate(_arrays(batch, width)):
                    found = np.asarray(run(x.reshape(channels, -1)), np.float32).ravel()
                    yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:width]), _list([found])], names=[*batch.schema.names[:width], "output"])

        kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
        return rows.select(*keys, "offset", "total", "samples").mapInArrow(each, f"{kinds}, offset long, total long, output array<float>")

    return model

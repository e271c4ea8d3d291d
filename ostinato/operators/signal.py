"""Signal operators over chunks of samples: frames, spectra, onsets, drum hits, tempo, resampling and remixing.

A signal is rows (keys, chunk_no, start, sample_rate, channels, samples): interleaved float
samples of a bounded stretch, `start` in frames.  All chunks of a signal but the last have the
same length, a multiple of the hop.  What a chunk needs of its right neighbour comes by one window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up, ticks
from . import series

# fixed values: drum voices and the limits of their features
KICK, SNARE, CLOSED_HAT, OPEN_HAT = 36, 38, 42, 46
LOW_HZ, HIGH_HZ, KICK_LOW, HAT_HIGH, HAT_ZCR, CLOSED_DECAY = 150.0, 6000.0, 0.55, 0.15, 0.15, 0.4


def mono(samples: np.ndarray, channels: int) -> np.ndarray:
    return samples[: len(samples) // channels * channels].reshape(-1, channels).mean(1) if channels > 1 else samples


def with_halo(pcm: DataFrame, keys: Sequence[str], frames: int) -> DataFrame:
    """pcm with `halo`: the first `frames` frames of what follows each chunk (of its next chunk).

    Where the next chunk is shorter than that and isn't the last, the halo would be too short, so the query fails.
    """
    w = Window.partitionBy(*keys).orderBy("chunk_no")
    head = F.slice("samples", 1, (F.lit(frames) * F.col("channels")).cast("int"))
    following = F.lead(head).over(w)
    short = (F.size(following) < F.lit(frames) * F.col("channels")) & F.lead("chunk_no", 2).over(w).isNotNull()
    message = F.concat(F.lit("a chunk shorter than the reach of "), F.lit(str(frames)), F.lit(" frames follows chunk "), F.col("chunk_no").cast("string"))
    safe = F.when(short, F.raise_error(message).cast("array<float>")).otherwise(following)
    return pcm.withColumn("halo", F.coalesce(safe, F.array().cast("array<float>")))


def _kernel(df: DataFrame, keys: Sequence[str], schema: str, each: Callable[[dict], dict[str, np.ndarray]]) -> DataFrame:
    """Rows that `each` makes of one chunk (a dict of its columns), beside the keys."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {}
                for name, column in zip(batch.schema.names, batch.columns, strict=True):
                    value = column[i]
                    row[name] = value.values.to_numpy(zero_copy_only=False) if pa.types.is_list(value.type) and value.is_valid else value.as_py()
                found = each(row)
                n = len(found[names[0]])
                own = [batch.column(batch.schema.get_field_index(k)).take(pa.array(np.full(n, i))) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(found[x]) for x in names)], names=[*keys, *names])

    return df.mapInArrow(run, f"{kinds}, {schema}")


def framed(samples: np.ndarray, halo: np.ndarray, size: int, hop: int) -> np.ndarray:
    """The whole frames that begin in a chunk, as rows."""
    full = np.concatenate([samples, halo[: size - hop]])
    return np.lib.stride_tricks.sliding_window_view(full, size)[::hop][: -(-len(samples) // hop)] if len(full) >= size else np.zeros((0, size))


def frames(pcm: DataFrame, keys: Sequence[str], size: int, hop: int, cutoff: float | None = None) -> DataFrame:
    """(keys, frame, energy): root mean square of each frame, or, with a cutoff, the root of its windowed power from there up.

    Frames are whole ones only; the tail of a signal isn't padded.
    """

    def each(row: dict) -> dict[str, np.ndarray]:
        x = framed(mono(row["samples"], row["channels"]).astype(np.float64), mono(row["halo"], row["channels"]).astype(np.float64), size, hop)
        if cutoff is None:
            energy = np.sqrt((x * x).mean(1)) if len(x) else np.zeros(0)
        else:
            power = np.abs(np.fft.rfft(x * np.hanning(size), axis=1)) ** 2 if len(x) else np.zeros((0, size // 2 + 1))
            bins = np.arange(size // 2 + 1) * row["sample_rate"] / size
            energy = np.sqrt(power[:, (bins >= cutoff) & (np.arange(len(bins)) < size // 2)].sum(1))
        return {"frame": row["start"] // hop + np.arange(len(energy), dtype=np.int64), "energy": energy}

    return _kernel(with_halo(pcm, keys, size - hop).select(*keys, "start", "sample_rate", "channels", "samples", "halo"), keys, "frame long, energy double", each)


def onsets(pcm: DataFrame, keys: Sequence[str], sample_rate: int = 44100, size: int = 512, hop: int = 256, gap_ms: int = 60, spread: float = 1.5) -> DataFrame:
    """(keys, onset): first samples of the attacks in the whole band and from 6 kHz up, at least `gap_ms` apart."""
    gap = max(1, (gap_ms * sample_rate // 1000) // hop)

    def band(cutoff: float | None) -> DataFrame:
        rise = series.flux(frames(pcm, keys, size, hop, cutoff), keys, "frame")
        # no count of peaks, which would take all spectra again: a fold holds one batch of them, however long the signal is
        return series.spacing(series.peaks(series.threshold(rise, keys, spread=spread), keys, "frame"), keys, "frame", gap, None)

    merged = series.merge_onsets(band(None), band(HIGH_HZ), keys, "frame", gap, None)
    return merged.select(*keys, (F.col("frame") * hop).alias("onset"))


def tempo(pcm: DataFrame, keys: Sequence[str], sample_rate: int = 44100, size: int = 1024, hop: int = 512) -> DataFrame:
    """(keys, best_lag, bpm) from the flux of long frames."""
    rise = series.flux(frames(pcm, keys, size, hop), keys, "frame")
    found = series.tempo(rise, keys, "frame", rate=sample_rate / hop)
    every = pcm.select(*keys).distinct()
    return every.join(found, list(keys), "left").select(*keys, "best_lag", F.coalesce("bpm", F.lit(120)).alias("bpm"))


def hit_features(x: np.ndarray, rate: int, following: int) -> tuple[float, float, float, float, float]:
    """Shares of low and high power, zero-crossing rate, late loudness against early, and peak, of the signal from an onset on."""
    head = x[: rate // 20].astype(np.float64)
    size = 1 << max(0, len(head) - 1).bit_length() if len(head) else 1
    power = np.abs(np.fft.rfft(head * np.hanning(len(head)), size))[: max(1, size // 2)] ** 2 if len(head) else np.zeros(1)
    hz, total = np.arange(len(power)) * rate / size, power.sum()
    low, high = (power[hz < LOW_HZ].sum() / total, power[hz >= HIGH_HZ].sum() / total) if total > 0 else (0.0, 0.0)
    turns = float(np.mean((head[1:] >= 0) != (head[:-1] >= 0))) if len(head) > 1 else 0.0
    rms = lambda y: float(np.sqrt(np.mean(y.astype(np.float64) ** 2))) if len(y) else 0.0
    early, late = rms(x[: rate // 50]), rms(x[rate // 50 : min(rate * 150 // 1000, following)])
    return float(low), float(high), turns, late / early if early > 0 else 0.0, float(np.abs(head).max()) if len(head) else 0.0


def voice(low="low", high="high", zcr="zcr", decay="decay"):
    """The drum voice of a hit by its features."""
    hat = F.when(F.col(decay) < CLOSED_DECAY, CLOSED_HAT).otherwise(OPEN_HAT)
    return F.when(F.col(low) >= KICK_LOW, KICK).when((F.col(high) >= HAT_HIGH) & (F.col(zcr) >= HAT_ZCR), hat).otherwise(SNARE)


def drum_hits(pcm: DataFrame, found: DataFrame, keys: Sequence[str], chunk: int, sample_rate: int = 44100) -> DataFrame:
    """(keys, onset, low, high, zcr, decay, peak, pitch) of each onset; onsets meet the chunk of `chunk` frames that they are in."""
    reach = sample_rate * 150 // 1000
    w = Window.partitionBy(*keys).orderBy("onset")
    placed = found.withColumn("following", F.coalesce(F.lead("onset").over(w) - F.col("onset"), F.lit(1 << 40))).withColumn("chunk_no", F.floor(F.col("onset") / chunk).cast("long"))
    # an onset list of one chunk is bounded by the spacing of onsets
    lists = placed.groupBy(*keys, "chunk_no").agg(F.array_sort(F.collect_list(F.struct("onset", "following"))).alias("o"))
    rows = with_halo(pcm, keys, reach).withColumn("chunk_no", F.col("chunk_no").cast("long")).join(lists, [*keys, "chunk_no"])
    rows = rows.select(*keys, "start", "channels", "samples", "halo", F.col("o.onset").alias("at"), F.col("o.following").alias("next"))

    def each(row: dict) -> dict[str, np.ndarray]:
        x = np.concatenate([mono(row["samples"], row["channels"]), mono(row["halo"], row["channels"])])
        got = [hit_features(x[o - row["start"] :][:reach], sample_rate, n) for o, n in zip(row["at"].tolist(), row["next"].tolist(), strict=True)]
        columns = np.array(got).reshape(-1, 5).T
        return {"onset": row["at"].astype(np.int64), **dict(zip(("low", "high", "zcr", "decay", "peak"), columns, strict=True))}

    made = _kernel(rows, keys, "onset long, low double, high double, zcr double, decay double, peak double", each)
    return made.withColumn("pitch", voice())


def drum_notes(pcm: DataFrame, keys: Sequence[str], bpm: DataFrame, chunk: int, sample_rate: int = 44100) -> DataFrame:
    """(keys, start_tick, end_tick, pitch, velocity): notes of 60 ms, as loud as their peak against the whole signal's."""
    hits = drum_hits(pcm, onsets(pcm, keys, sample_rate), keys, chunk, sample_rate)
    loudest = pcm.groupBy(*keys).agg(F.max(F.array_max(F.transform("samples", F.abs))).cast("double").alias("_most"))
    joined = hits.join(loudest, list(keys)).join(bpm.select(*keys, "bpm"), list(keys))
    seconds = F.col("onset") / sample_rate
    velocity = F.when(F.col("_most") > 0, half_up(127 * F.col("peak") / F.col("_most"))).otherwise(40)
    return joined.select(*keys, ticks(seconds, F.col("bpm")).alias("start_tick"), ticks(seconds + 0.06, F.col("bpm")).alias("end_tick"), "pitch", F.greatest(F.lit(40), F.least(F.lit(127), velocity)).cast("int").alias("velocity"))


def remix(pcm: DataFrame, keys: Sequence[str], channels: int) -> DataFrame:
    """pcm with another number of channels: the same, copies of one, or the mean of all in each."""

    def each(row: dict) -> dict[str, np.ndarray]:
        x, n = row["samples"], row["channels"]
        if n != channels:
            x = np.repeat(x.reshape(-1, n).astype(np.float64).mean(1).astype(np.float32), channels)
        return {"samples": [x], "chunk_no": [row["chunk_no"]], "start": [row["start"]], "sample_rate": np.array([row["sample_rate"]], np.int32), "channels": np.array([channels], np.int32)}

    source = pcm.select(*keys, F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start").cast("long").alias("start"), "sample_rate", "channels", "samples")
    return _kernel(source, keys, "samples array<float>, chunk_no long, start long, sample_rate int, channels int", each)


def resample(pcm: DataFrame, keys: Sequence[str], target: int) -> DataFrame:
    """pcm at another rate by linear interpolation; a chunk needs one frame of the next, and the last frame is held."""
    total = pcm.groupBy(*keys).agg(F.sum(F.size("samples") / F.col("channels")).cast("long").alias("total"))
    source = with_halo(pcm, keys, 1).join(total, list(keys)).select(*keys, F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start").cast("long").alias("start"), "sample_rate", "channels", "samples", "halo", "total")

    def each(row: dict) -> dict[str, np.ndarray]:
        c, rate = row["channels"], row["sample_rate"]
        x = np.concatenate([row["samples"], row["halo"]]).reshape(-1, c).astype(np.float64)
        lo, n = row["start"], len(row["samples"]) // c
        outs = row["total"] * target // rate
        first, last = -(-lo * target // rate), min(-(-(lo + n) * target // rate), outs)
        k = np.arange(first, max(first, last))
        pos = k * rate / target - lo
        left = np.minimum(np.floor(pos).astype(np.int64), len(x) - 1)
        right = np.minimum(left + 1, len(x) - 1)
        y = x[left] + (x[right] - x[left]) * (pos - left)[:, None] if len(k) else np.zeros((0, c))
        return {"samples": [y.astype(np.float32).ravel()], "chunk_no": [row["chunk_no"]], "start": [int(first)], "sample_rate": np.array([target], np.int32), "channels": np.array([c], np.int32)}

    return _kernel(source, keys, "samples array<float>, chunk_no long, start long, sample_rate int, channels int", each)

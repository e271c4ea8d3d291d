"""From samples to MIDI files: separation, notes, tempo, gates, instruments, and writing.

Separation, note activations and tagging need models, which aren't part of this library: each is
a function from DataFrame to DataFrame.  `per_worker` keeps a loaded model for all tasks of a worker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import activations, separation, signal, stems, tagging, windows
from ..sources import midi
from ..tables import written

KEYS = ["track_id", "stem"]


@cache
def per_worker(load: Callable[[], object]) -> object:
    """The model that `load` (a named function) makes, once for each Python worker."""
    return load()


def one_stem(pcm: DataFrame, label: str = "mix") -> DataFrame:
    """The separation of those who have no model: everything is one stem."""
    return pcm.withColumn("stem", F.lit(label))


@dataclass
class Models:
    """What the caller gives.

    Stems come from separate_slices: (track_id, offset, total, samples), each the model's input of one
    channel after another at 44100 Hz -> (track_id, offset, total, output), flat over `sources`, channels and
    samples; slices, overlap-add and trimming are done around it.  Or from separate: pcm -> pcm with stem.

    Tags come from tag_patches: (track_id, stem, window_no, samples), each of `patch` mono samples at
    16000 Hz, every `patch_hop` -> (track_id, stem, scores), a row of 521 scores a patch; they are pooled and
    mapped to programs.  Or from tag: pcm of stems -> (track_id, stem, class, score).

    Notes come from activate_windows: (track_id, stem, window_no, samples), each of 43844 mono samples at
    22050 Hz -> (track_id, stem, window_no, f, frame, onset), 172 rows a window; or from activate, which
    cuts the pcm of stems itself: -> (track_id, stem, t, frame, onset).
    """

    separate: Callable[[DataFrame], DataFrame] = one_stem
    activate: Callable[[DataFrame], DataFrame] | None = None
    activate_windows: Callable[[DataFrame], DataFrame] | None = None
    tag: Callable[[DataFrame], DataFrame] | None = None
    separate_slices: Callable[[DataFrame], DataFrame] | None = None
    sources: tuple[str, ...] = separation.SOURCES
    segment: int = separation.SEGMENT
    tag_patches: Callable[[DataFrame], DataFrame] | None = None
    patch: int = 15_600
    patch_hop: int = 7_680


def stems_of(pcm: DataFrame, models: Models, chunk: int, sample_rate: int) -> DataFrame:
    """pcm with stem, in chunks of `chunk` frames where a model of slices makes them."""
    if models.separate_slices is None:
        return models.separate(pcm)
    track = ["track_id"]
    wide = signal.resample(signal.remix(pcm, track, separation.CHANNELS), track, sample_rate)
    return separation.separated(wide, models.separate_slices, track, models.sources, models.segment, chunk=chunk, sample_rate=sample_rate)


def tags_of(own: DataFrame, models: Models) -> DataFrame | None:
    """(track_id, stem, class, score) of stems, by the model that the caller gives."""
    if models.tag_patches is None:
        return models.tag(own) if models.tag is not None else None
    heard = windows.fixed(mono_at(own, tagging.TAG_RATE), KEYS, models.patch, models.patch_hop, 0)
    return tagging.tags(models.tag_patches(heard), KEYS)


def loudness(pcm: DataFrame) -> DataFrame:
    """(track_id, stem, rms) over all samples."""
    squares = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n = F.sum(F.size("samples"))
    return pcm.groupBy(*KEYS).agg(F.when(n > 0, F.sqrt(F.sum(squares) / n)).otherwise(0.0).alias("rms"))


def mono_at(pcm: DataFrame, rate: int = N.SAMPLE_RATE) -> DataFrame:
    """Stems in one channel at `rate`, in chunks as they were cut."""
    return signal.resample(signal.remix(pcm, KEYS, 1), KEYS, rate)


def matrix_of(audio: DataFrame, activate_windows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(track_id, stem, t, frame, onset) from a model that takes fixed windows of mono samples."""
    return windows.trimmed(activate_windows(windows.fixed(audio, KEYS)), KEYS, windows.frame_totals(audio, KEYS))


def rechunked(audio: DataFrame, chunk: int = 1 << 15) -> DataFrame:
    """A mono signal in chunks of equal length, as span lookups want them."""
    return windows.fixed(audio, KEYS, chunk, chunk, 0).select(*KEYS, F.col("window_no").alias("chunk_no"), (F.col("window_no") * chunk).alias("start"), "samples")


def pitched_notes(matrix: DataFrame, audio: DataFrame, bpm: DataFrame, frame_least: float = 0.3, chunk: int = 1 << 15) -> DataFrame:
    """Notes of all stems with ticks and velocities: the peak of the note's own mono samples against the stem's, times 127, within 40 and 127.

    How sure the model is of a note says nothing of how loud it is.
    """
    found = activations.notes(matrix, KEYS, frame_least).join(bpm.select("track_id", "bpm"), "track_id")
    loudest = audio.groupBy(*KEYS).agg(F.max(F.array_max(F.transform("samples", F.abs))).cast("double").alias("_most"), F.sum(F.size("samples")).alias("_size"))
    sample = lambda c: F.least(N.half_up(N.frame_seconds(F.col(c)) * N.SAMPLE_RATE), F.col("_size"))
    spans = found.join(loudest, KEYS).withColumn("_from", sample("start_frame")).withColumn("_to", sample("end_frame"))
    heard = windows.span_peaks(rechunked(audio, chunk), spans, KEYS, "_from", "_to", chunk)
    at = lambda c: N.ticks(N.frame_seconds(F.col(c)), F.col("bpm"))
    loud = N.half_up(127 * F.col("peak") / F.greatest(F.col("_most"), F.lit(1e-6)))
    return heard.select(*KEYS, at("start_frame").alias("start_tick"), at("end_frame").alias("end_tick"), "pitch", N.clip(loud, 40, 127).cast("int").alias("velocity"))


def analyze(pcm: DataFrame, models: Models, labels: list[str] | None = None, chunk: int = 1 << 16, sample_rate: int = 44100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, parts, tempo) of each track.

    Stems and activations that models make are written to the shared folder, as several steps read them.
    Stems are chosen before the tempo is taken, so without drums it is 120.  Pitched stems that are
    silent against the loudest are left out, and the velocities of the rest are balanced.
    """
    own = stems_of(pcm, models, chunk, sample_rate)
    if models.separate is not one_stem or models.separate_slices is not None:
        own = written(own)  # so that the model runs once, whatever reads its stems
    own = own.filter(F.col("stem").isin(labels)) if labels is not None else own
    drums = own.filter("stem = 'drums'")
    found = signal.tempo(drums, KEYS, sample_rate).select("track_id", "bpm")
    tempo = pcm.select("track_id").distinct().join(found, "track_id", "left").select("track_id", F.coalesce("bpm", F.lit(120)).alias("bpm"))
    beats = drums.select(*KEYS).distinct().join(tempo, "track_id")
    hits = signal.drum_notes(drums, KEYS, beats, chunk, sample_rate)
    rms = loudness(own.filter("stem <> 'drums'"))
    kept = stems.silent(rms, ["track_id"]).filter("NOT silent").drop("silent")
    notes = hits
    if models.activate is not None or models.activate_windows is not None:
        voices = own.filter("stem <> 'drums'")
        audio = mono_at(voices)
        matrix = written(models.activate(voices) if models.activate is not None else matrix_of(audio, models.activate_windows))
        pitched = pitched_notes(matrix, audio, tempo).join(kept.select(*KEYS), KEYS, "left_semi")
        balanced = stems.balanced(pitched, stems.velocity_scales(kept, ["track_id"]), KEYS)
        notes = hits.unionByName(balanced.withColumn("velocity", F.col("velocity").cast("int")).select(*hits.columns))
    notes = notes.withColumn("seq", F.xxhash64("start_tick", "pitch", "end_tick"))
    parts = kept.select(*KEYS).unionByName(drums.select(*KEYS).distinct())
    second = (F.col("bpm") * N.TICKS_PER_QUARTER) / 60.0
    timed = notes.join(tempo, "track_id").withColumn("s", F.col("start_tick") / second).withColumn("e", F.col("end_tick") / second)
    shapes = stems.roles(stems.note_shapes(timed, KEYS, "s", "e", "pitch", "seq")).select(*KEYS, F.col("program").alias("role_program"))
    tags = tags_of(own, models)
    parts = parts.join(shapes, KEYS, "left")
    parts = parts.join(tags, KEYS, "left") if tags is not None else parts.withColumn("class", F.lit(None).cast("int")).withColumn("score", F.lit(None).cast("double"))
    sizes = own.groupBy(*KEYS).agg((F.sum(F.size("samples")) <= 0).alias("audio_empty"))
    named = stems.instruments(parts.join(sizes, KEYS).withColumn("label", F.col("stem")))
    return notes, named.select(*KEYS, F.dense_rank().over(_by_stem()).alias("ord"), "program", "drum", "confidence"), tempo


def _by_stem():
    from pyspark.sql import Window

    return Window.partitionBy("track_id").orderBy("stem")


def review(parts: DataFrame, excluded: DataFrame | None = None, programs: DataFrame | None = None) -> DataFrame:
    """parts without the excluded (track_id, stem) rows, with the overriding (track_id, stem, override) programs, and what each program is called."""
    out = parts.join(excluded, KEYS, "left_anti") if excluded is not None else parts
    out = stems.overridden(out, programs, KEYS) if programs is not None else out
    return stems.named(out)


def write(notes: DataFrame, parts: DataFrame, tempo: DataFrame, kind: int = 0) -> DataFrame:
    """(track_id, content) of the MIDI files; notes of stems that were left out go."""
    return midi.files(notes.join(parts.select(*KEYS), KEYS, "left_semi"), parts, tempo, kind)


def write_stems(notes: DataFrame, parts: DataFrame, tempo: DataFrame) -> DataFrame:
    """One file for each stem: (track_id, content) with `<track>/<stem>` as track_id, which `midi.save` keeps as folders."""
    name = F.concat_ws("/", "track_id", "stem").alias("track_id")
    own = lambda df: df.select(name, *[c for c in df.columns if c != "track_id"])
    tempos = parts.join(tempo, "track_id").select(name, "bpm")
    return midi.files(own(notes.join(parts.select(*KEYS), KEYS, "left_semi")), own(parts), tempos, 0)


def save(folder: str, notes: DataFrame, parts: DataFrame, tempo: DataFrame, options: dict[str, str] | None = None) -> None:
    """Keep an analysis for a later review: Parquet tables of notes, parts, tempo and options."""
    spark = notes.sparkSession
    rows = spark.createDataFrame(sorted((options or {}).items()), "name string, value string")
    for name, df in (("notes", notes), ("parts", parts), ("tempo", tempo), ("options", rows)):
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def load(spark, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, str]]:
    """(notes, parts, tempo, options) of a kept analysis."""
    notes, parts, tempo, options = (spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in ("notes", "parts", "tempo", "options"))
    return notes, parts, tempo, {r.name: r.value for r in options.collect()}  # a handful of settings

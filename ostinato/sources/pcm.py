"""Samples in chunk rows: WAV files, raw float files, and a hook for other decoders."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import stores

SHAPE = "track_id string, chunk_no long, start long, sample_rate int, channels int, samples array<float>"
CHUNK = 1 << 16
#: Endings that are taken for audio; a hook must know all but .wav.
AUDIO = ("wav", "mp3", "m4a", "aac", "ogg", "opus", "flac")

Decoded = tuple[int, int, np.ndarray]


def floats(raw: bytes, width: int) -> np.ndarray:
    """Samples of 8, 16, 24 or 32 bit PCM."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8)[: len(wide) * 3].reshape(-1, 3)
        x = wide.view("<i4").ravel().astype(np.float64) / 2**31
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / 2.0 ** (8 * width - 1)
    return x.astype(np.float32)


def decode_wav(data: bytes) -> Decoded:
    """(rate, channels, interleaved samples) of 8, 16, 24 or 32 bit PCM."""
    with wave.open(io.BytesIO(data)) as file:
        rate, channels, width = file.getframerate(), file.getnchannels(), file.getsampwidth()
        raw = file.readframes(file.getnframes())
    return rate, channels, floats(raw, width)


def read_audio(spark: SparkSession, path: str, decode: Callable[[bytes], Decoded] = decode_wav, chunk: int = CHUNK, glob: str | None = None) -> DataFrame:
    """Chunk rows of every file; a file is decoded in one task, in a store that Spark reads.

    Without `glob`, files are taken by their endings: .wav, or all of `AUDIO` for another decoder.
    """
    glob = glob or ("*.wav" if decode is decode_wav else f"*.{{{','.join(AUDIO)}}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rate, channels, x = decode(data)
                for k, at in enumerate(range(0, len(x) // channels, chunk)):
                    part = pa.array([x[at * channels : (at + chunk) * channels]], pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([at], pa.int64()), pa.array([rate], pa.int32()), pa.array([channels], pa.int32()), part], names=[p.split()[0] for p in SHAPE.split(", ")])

    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return found.select("path", "content").mapInArrow(run, SHAPE)


def durations(pcm: DataFrame) -> DataFrame:
    """(track_id, duration_us) from the chunks."""
    end = F.max(F.col("start") + F.size("samples") / F.col("channels"))
    return pcm.groupBy("track_id").agg(F.coalesce((end * 1_000_000 / F.max("sample_rate")).cast("long"), F.lit(0).cast("long")).alias("duration_us"))


def scaled(pcm: DataFrame, column: str = "shorts") -> DataFrame:
    """`samples` from 16-bit numbers."""
    return pcm.withColumn("samples", F.transform(column, lambda x: (x / 32768.0).cast("float"))).drop(column)


def tamed(column: str = "samples"):
    """Samples with 0 for what isn't a number or lies beyond 4."""
    return F.transform(column, lambda x: F.when(F.isnan(x) | (F.abs(x) > 4), F.lit(0.0).cast("float")).otherwise(x))


class _Part(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        super().__init__(None)
        self.path, self.first, self.end = path, first, end


class _RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rate, self.channels = options["path"], int(options.get("rate", 44100)), int(options.get("channels", 2))
        self.chunk, self.per_task = int(options.get("chunk", CHUNK)), int(options.get("chunks_per_task", 64))

    def partitions(self) -> list[InputPartition]:
        """Whole chunks, some for each task; bytes after the last whole frame are left out."""
        store, root = stores.opened(self.path)
        own = store.get_file_info(root)
        files = sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda f: f.path) if own.type == fs.FileType.Directory else [own]
        step, out = self.chunk * self.per_task, []
        for file in files:
            n = file.size // (4 * self.channels) if file.type == fs.FileType.File else 0
            out += [_Part(file.path, at, min(n, at + step)) for at in range(0, n, step)]
        return out

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        size, (store, _) = 4 * self.channels, stores.opened(self.path)
        with store.open_input_file(part.path) as file:
            file.seek(part.first * size)
            for at in range(part.first, part.end, self.chunk):
                x = np.frombuffer(file.read(min(self.chunk, part.end - at) * size), "<f4")
                yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([at // self.chunk], pa.int64()), pa.array([at], pa.int64()), pa.array([self.rate], pa.int32()), pa.array([self.channels], pa.int32()), pa.array([x], pa.list_(pa.float32()))], names=[p.split()[0] for p in SHAPE.split(", ")])


@dataclass
class Header:
    """What a WAV file says of its samples: rate, channels, bytes a sample, whether they are floats, where they begin and how many bytes they have."""

    rate: int
    channels: int
    width: int
    real: bool
    begin: int
    size: int


def wav_header(file, size: int) -> Header:
    """The header of an open WAV file of `size` bytes; also RF64, whose sizes need more than 32 bits.  Samples end with the file at the latest."""
    head = file.read(12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError("no WAV file")
    at, shape, large = 12, None, None
    while at + 8 <= size:
        file.seek(at)
        name, n = struct.unpack("<4sI", file.read(8))
        if name == b"data":
            if shape is None:
                raise ValueError("a WAV file without a format before its samples")
            n = large if n == 0xFFFFFFFF and large is not None else n
            return Header(*shape, at + 8, min(n, size - at - 8))
        if name == b"ds64":
            large = struct.unpack("<QQ", file.read(16))[1]
        if name == b"fmt ":
            own = file.read(n)
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", own[:16])
            kind = struct.unpack("<H", own[24:26])[0] if kind == 0xFFFE and n >= 26 else kind
            width = (bits + 7) // 8
            if channels < 1 or rate < 1 or not (kind == 1 and 1 <= width <= 4 or kind == 3 and width in (4, 8)):
                raise ValueError(f"a WAV format that isn't known: {kind}, {bits} bits, {channels} channels")
            shape = rate, channels, width, kind == 3
        at += 8 + n + n % 2
    raise ValueError("a WAV file without samples")


@dataclass
class _Pieces(InputPartition):
    """Byte ranges of files: (path, size of the file, first, end)."""

    pieces: list[tuple[str, int, int, int]]

    def __post_init__(self):
        super().__init__(None)


class _WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.per_task, self.ending = int(options.get("bytes_per_task", 64 << 20)), options.get("ending", ".wav")

    def partitions(self) -> list[InputPartition]:
        """Ranges of about equal size; small files share one.  Only names and sizes are looked at, so headers are the tasks' work."""
        store, root = stores.opened(self.path)
        own = store.get_file_info(root)
        files = store.get_file_info(fs.FileSelector(root, recursive=True)) if own.type == fs.FileType.Directory else [own]
        files = sorted((f for f in files if f.type == fs.FileType.File and (own.type == fs.FileType.File or f.path.lower().endswith(self.ending))), key=lambda f: f.path)
        out, open_, used = [], [], 0
        for file in files:
            for at in range(0, file.size, self.per_task):
                end = min(file.size, at + self.per_task)
                if open_ and used + end - at > self.per_task:
                    out.append(_Pieces(open_))
                    open_, used = [], 0
                open_.append((file.path, file.size, at, end))
                used += end - at
        return out + ([_Pieces(open_)] if open_ else [])

    def read(self, part: _Pieces) -> Iterator[pa.RecordBatch]:
        """The chunks whose first byte lies in the task's ranges, each of them whole."""
        store, _ = stores.opened(self.path)
        for path, size, first, end in part.pieces:
            with store.open_input_file(path) as file:
                try:
                    head = wav_header(file, size)
                except ValueError as error:
                    raise ValueError(f"{path}: {error}") from None
                frame = head.channels * head.width
                n, step = head.size // frame, self.chunk * frame
                k = max(0, -(-(first - head.begin) // step))
                while k * self.chunk < n and head.begin + k * step < end:
                    file.seek(head.begin + k * step)
                    raw = file.read(min(self.chunk, n - k * self.chunk) * frame)
                    x = np.frombuffer(raw, f"<f{head.width}").astype(np.float32) if head.real else floats(raw, head.width)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([k * self.chunk], pa.int64()), pa.array([head.rate], pa.int32()), pa.array([head.channels], pa.int32()), pa.array([x], pa.list_(pa.float32()))], names=[p.split()[0] for p in SHAPE.split(", ")])
                    k += 1


class WavRanges(DataSource):
    """WAV files of any size in a folder that all executors reach, in chunk rows, a file in as many tasks as its size asks for.

    spark.read.format("wav_ranges").options(chunk=..., bytes_per_task=...).load(path)
    """

    @classmethod
    def name(cls) -> str:
        return "wav_ranges"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> DataSourceReader:
        return _WavReader(dict(self.options))


def read_wav(spark: SparkSession, path: str, chunk: int = CHUNK, bytes_per_task: int = 64 << 20) -> DataFrame:
    """Chunk rows of WAV files by byte ranges: no task holds more than a chunk, and a large file is many tasks.

    `track_id` is the path in its store.  PCM of 8 to 32 bits, floats and RF64 are read; another
    format, or a file without samples, fails with its name.
    """
    spark.dataSource.register(WavRanges)
    return spark.read.format("wav_ranges").options(chunk=chunk, bytes_per_task=bytes_per_task).load(path)


class _RawWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows) -> WriterCommitMessage:
        store, root = stores.opened(self.folder)
        for name, own in groupby(rows, key=lambda r: r[0]):
            stores.put(store, f"{root}/{stores.relative(name)}.f32", (np.asarray(r[1], "<f4").tobytes() for r in own))
        return WriterCommitMessage()


class RawSamples(DataSource):
    """Interleaved little-endian floats in a folder that all executors reach, without a header.

    spark.read.format("pcm_f32le").options(rate=..., channels=...).load(path) reads files by byte ranges;
    `save_raw` writes them.
    """

    @classmethod
    def name(cls) -> str:
        return "pcm_f32le"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> DataSourceReader:
        return _RawReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _RawWriter(self.options["path"])


def save_raw(pcm: DataFrame, folder: str, keys: tuple[str, ...] = ("track_id",)) -> None:
    """`<keys>.f32` for each signal; its chunks are appended in order by one task, a chunk at a time."""
    named = pcm.select(F.concat_ws("/", *keys).alias("name"), "samples", F.col("chunk_no").cast("long").alias("chunk_no"))
    pcm.sparkSession.dataSource.register(RawSamples)
    named.repartition("name").sortWithinPartitions("name", "chunk_no").select("name", "samples").write.format("pcm_f32le").mode("append").save(folder)


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """(index, mid, display_name): the classes of a tagging model, from a CSV file with a header."""
    return spark.read.csv(path, header=True, schema="index int, mid string, display_name string", quote='"', escape='"')

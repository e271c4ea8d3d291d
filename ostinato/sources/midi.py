"""Standard MIDI Files: reading into event rows, writing from notes.

Files come through Spark's binaryFile reader, so any store that Spark reads will do; one file is
parsed in one task.  Ticks become milliseconds by an as-of join over the tempo changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators import joins, stems
from . import stores

DIVISION = 480
#: Order of equal times in a file, and when read.
WRITE_ORDER = {"TEMPO": 0, "PROGRAM": 1, "OFF": 2, "ON": 3}
READ_ORDER = {"PROGRAM": 0, "OFF": 1, "ON": 2}
_SKIP = {0xA0: 2, 0xB0: 2, 0xE0: 2, 0xD0: 1}


def vlq(number: int) -> bytes:
    out = [number & 127]
    while number := number >> 7:
        out.append(number & 127 | 128)
    return bytes(reversed(out))


def track_bytes(events: list[tuple[int, bytes]]) -> bytes:
    """A track chunk of (tick, message) pairs in their order, with the end mark."""
    body, at = bytearray(), 0
    for tick, message in events:
        body += vlq(tick - at) + message
        at = tick
    body += b"\x00\xff\x2f\x00"
    return b"MTrk" + len(body).to_bytes(4, "big") + bytes(body)


def header(kind: int, tracks: int, division: int = DIVISION) -> bytes:
    return b"MThd" + b"".join(x.to_bytes(n, "big") for x, n in ((6, 4), (kind, 2), (tracks, 2), (division, 2)))


def message(kind: str, channel: int, a: int, b: int) -> bytes:
    if kind == "TEMPO":
        return b"\xff\x51\x03" + a.to_bytes(3, "big")
    return bytes([0xC0 | channel, a]) if kind == "PROGRAM" else bytes([(0x90 if kind == "ON" else 0x80) | channel, a, b])


def parse(data: bytes) -> tuple[int, list[tuple[int, int, str, int, int, int]]]:
    """(division, events); an event is (track, tick, type, channel, data1, data2), TEMPO with microseconds in data1."""
    if data[:4] != b"MThd" or len(data) < 14:
        raise ValueError("no MIDI header")
    size, kind, tracks, division = (int.from_bytes(data[a:b], "big") for a, b in ((4, 8), (8, 10), (10, 12), (12, 14)))
    if kind > 1 or division & 0x8000:
        raise ValueError("only formats 0 and 1 with ticks per quarter are read")
    at, out = 8 + size, []

    def number(at: int) -> tuple[int, int]:
        value = 0
        while True:
            value = value << 7 | data[at] & 127
            at += 1
            if data[at - 1] < 128:
                return value, at

    for track in range(tracks):
        if data[at : at + 4] != b"MTrk":
            raise ValueError("no MIDI track")
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "big")
        at, tick, status = at + 8, 0, 0
        while at < end:
            step, at = number(at)
            tick += step
            if data[at] >= 128:
                status = data[at]
                at += 1
            top, channel = status & 0xF0, status & 15
            if status == 0xFF:
                meta = data[at]
                n, at = number(at + 1)
                if meta == 0x51 and n == 3:
                    out.append((track, tick, "TEMPO", 0, int.from_bytes(data[at : at + 3], "big"), 0))
                at += n
            elif status in (0xF0, 0xF7):
                n, at = number(at)
                at += n
            elif top in (0x80, 0x90):
                out.append((track, tick, "ON" if top == 0x90 and data[at + 1] else "OFF", channel, data[at], data[at + 1]))
                at += 2
            elif top == 0xC0:
                out.append((track, tick, "PROGRAM", channel, data[at], 0))
                at += 1
            elif top in _SKIP:
                at += _SKIP[top]
            else:
                raise ValueError(f"unknown status {status:#x}")
        at = end
    return division, out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, track, tick, type, channel, data1, data2, division) of every event of the files; bad files have one row with `error`."""
    shape = "path string, seq long, track int, tick long, type string, channel int, data1 int, data2 int, division int, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    division, events = parse(data)
                    rows = [(name, k, tr, t, kind, c, a, b, division, None) for k, (tr, t, kind, c, a, b) in enumerate(events)]
                except (ValueError, IndexError) as e:
                    rows = [(name, -1, None, None, None, None, None, None, None, str(e) or "cut short")]
                types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                columns = list(zip(*rows, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[p.split()[0] for p in shape.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, shape)


def timed(events: DataFrame) -> DataFrame:
    """(path, place, ms, channel, type, data1, data2): notes and programs in the order of time; the tempo map is one for all tracks of a file."""
    good = events.filter("error IS NULL")
    changes = good.filter("type = 'TEMPO'").select("path", "tick", F.col("data1").alias("micros"), "seq")
    rows = good.filter("type <> 'TEMPO'").select("path", "tick", "seq", "channel", "type", "data1", "data2", "division")
    placed = joins.tempo_ms(rows, changes, ["path"], division=F.col("division"))
    rank = F.create_map(*[F.lit(x) for pair in READ_ORDER.items() for x in pair])[F.col("type")]
    w = Window.partitionBy("path").orderBy("ms", rank, "seq")
    return placed.select("path", (F.row_number().over(w) - 1).alias("place"), "ms", "channel", "type", "data1", "data2")


def durations(events: DataFrame) -> DataFrame:
    """(path, duration_ms): the time of the last event, 0 without any."""
    last = timed(events).groupBy("path").agg(F.max("ms").alias("_last"))
    return events.select("path").distinct().join(last, "path", "left").select("path", F.coalesce("_last", F.lit(0)).alias("duration_ms"))


def note_events(notes: DataFrame, parts: DataFrame) -> DataFrame:
    """Events (track_id, stem, tick, type, channel, data1, data2, seq) of notes and of the stems' programs.

    notes: track_id, stem, seq, start_tick, end_tick, pitch, velocity; parts: track_id, stem, ord, program, drum.
    """
    numbered = stems.channels(parts, ["track_id"], "ord", F.col("drum"))
    row = lambda tick, kind, a, b: F.struct(F.col(tick).cast("long").alias("tick"), F.lit(kind).alias("type"), F.col(a).cast("int").alias("data1"), (F.col(b) if b else F.lit(0)).cast("int").alias("data2"))
    own = notes.join(numbered.select("track_id", "stem", "channel"), ["track_id", "stem"])
    both = own.select("track_id", "stem", "channel", "seq", F.explode(F.array(row("start_tick", "ON", "pitch", "velocity"), row("end_tick", "OFF", "pitch", None))).alias("e")).select("track_id", "stem", "channel", "seq", "e.*")
    programs = numbered.select("track_id", "stem", "channel", F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("tick"), F.lit("PROGRAM").alias("type"), F.col("program").cast("int").alias("data1"), F.lit(0).alias("data2"))
    return both.withColumn("seq", F.col("seq").cast("long")).unionByName(programs)


def files(notes: DataFrame, parts: DataFrame, bpm: DataFrame, kind: int = 0) -> DataFrame:
    """(track_id, content): a file for each track_id, of one merged track (kind 0) or one for the tempo and one for each stem (kind 1)."""
    if kind not in (0, 1):
        raise ValueError("kind is 0 or 1")
    rank = F.create_map(*[F.lit(x) for pair in WRITE_ORDER.items() for x in pair])
    events = note_events(notes, parts).join(parts.select("track_id", "stem", "ord"), ["track_id", "stem"])
    micros = F.floor(F.lit(60_000_000) / F.col("bpm")).cast("int")
    tempo = bpm.select("track_id", F.lit(-1).alias("ord"), F.lit(0).cast("long").alias("tick"), F.lit("TEMPO").alias("type"), F.lit(0).cast("long").alias("channel"), micros.alias("data1"), F.lit(0).alias("data2"), F.lit(-2).cast("long").alias("seq"))
    every = events.select(*tempo.columns).unionByName(tempo)
    line = F.struct((F.col("ord") * kind).alias("line"), "tick", rank[F.col("type")].alias("rank"), "ord", "seq", "type", "channel", "data1", "data2")
    # a piece of music is one file, so its events meet in one row
    whole = every.groupBy("track_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    id_kind = parts.schema["track_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lines in batch.column(1).to_pylist():
                tracks: dict[int, list] = {}
                for x in lines:
                    tracks.setdefault(x["line"], []).append((x["tick"], message(x["type"], x["channel"], x["data1"], x["data2"])))
                out.append(header(kind, len(tracks)) + b"".join(track_bytes(tracks[k]) for k in sorted(tracks)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["track_id", "content"])

    return whole.mapInArrow(run, f"track_id {id_kind}, content binary")


class _Written(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows) -> WriterCommitMessage:
        store, root = stores.opened(self.folder)
        for row in rows:
            stores.put(store, f"{root}/{stores.relative(row[0])}.mid", [row[1]])  # a task that is run again writes the same file
        return WriterCommitMessage()


class MidiFiles(DataSource):
    """df.write.format("midi_files").save(folder): `<name>.mid` for each (name, content) row; folders in the name are kept.

    The folder is a path or an address that pyarrow's file systems know, and all executors reach.
    """

    @classmethod
    def name(cls) -> str:
        return "midi_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Written(self.options["path"])


def save(files: DataFrame, folder: str) -> None:
    """Write (track_id, content) files below a folder; two rows for one file are an error, and nothing is written then."""
    spark = files.sparkSession
    named = files.select(F.col("track_id").cast("string").alias("name"), "content")
    twice = named.groupBy("name").count().filter("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"several files for {', '.join(str(r.name) for r in twice)}")
    spark.dataSource.register(MidiFiles)
    named.write.format("midi_files").mode("append").save(folder)

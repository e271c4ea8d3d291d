import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.plans import convert
from ostinato.sources import midi, pcm, stores
from ostinato.streaming import overlap as stream

from .test_operators import pcm as chunks

NOTES = "track_id string, stem string, seq long, start_tick long, end_tick long, pitch int, velocity int"
PARTS = "track_id string, stem string, ord int, program int, drum boolean"


@pytest.mark.parametrize("kind", [0, 1])
def test_round_trip(spark, tmp_path, kind):
    notes = spark.createDataFrame([("a", "drums", 0, 0, 240, 36, 100), ("a", "piano", 0, 480, 960, 60, 90), ("a", "piano", 1, 960, 1440, 64, 90)], NOTES)
    parts = spark.createDataFrame([("a", "drums", 0, 0, True), ("a", "piano", 1, 4, False)], PARTS)
    files = midi.files(notes, parts, spark.createDataFrame([("a", 120)], "track_id string, bpm int"), kind)
    spark.dataSource.register(midi.MidiFiles)
    folder = f"{tmp_path}/out"
    files.select(F.col("track_id").alias("name"), "content").write.format("midi_files").mode("append").save(folder)
    events = midi.read(spark, f"{folder}/a.mid")
    timed = [(r.ms, r.channel, r.type, r.data1) for r in midi.timed(events).orderBy("place").collect()]
    assert [t for t in timed if t[2] == "ON"] == [(0, 9, "ON", 36), (500, 0, "ON", 60), (1000, 0, "ON", 64)]
    assert sorted(t[0] for t in timed if t[2] == "OFF") == [250, 1000, 1500]
    assert {(t[1], t[3]) for t in timed if t[2] == "PROGRAM"} == {(9, 0), (0, 4)}
    assert midi.durations(events).first().duration_ms == 1500
    data = files.first().content
    assert data[:14] == midi.header(kind, 1 + 2 * kind) and data[-3:] == b"\xff\x2f\x00"


def test_tempo_change_in_another_track(spark, tmp_path):
    data = midi.header(1, 2) + midi.track_bytes([(960, b"\x90\x3c\x40")]) + midi.track_bytes([(480, midi.message("TEMPO", 0, 250_000, 0))])
    (tmp_path / "x.mid").write_bytes(data)
    assert [(r.ms, r.type) for r in midi.timed(midi.read(spark, str(tmp_path))).collect()] == [(750, "ON")]


def test_running_status_and_zero_velocity(spark, tmp_path):
    body = b"\x00\x90\x3c\x40\x64\x3c\x00\x00\xff\x2f\x00"
    (tmp_path / "x.mid").write_bytes(midi.header(0, 1) + b"MTrk" + len(body).to_bytes(4, "big") + body)
    (tmp_path / "bad.mid").write_bytes(b"nothing")
    events = midi.read(spark, str(tmp_path))
    assert [(r.ms, r.type) for r in midi.timed(events).orderBy("place").collect()] == [(0, "ON"), (104, "OFF")]
    assert events.filter("error IS NOT NULL").count() == 1


def test_wav_and_raw(spark, tmp_path):
    x = np.arange(-500, 500, dtype="<i2") * 30
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as file:
        file.setparams((2, 2, 8000, 0, "NONE", ""))
        file.writeframes(x.tobytes())
    (tmp_path / "x.wav").write_bytes(buffer.getvalue())
    got = pcm.read_audio(spark, str(tmp_path), chunk=128).orderBy("chunk_no").collect()
    assert np.allclose(np.concatenate([r.samples for r in got]), x / 32768) and got[1].start == 128
    assert pcm.durations(pcm.read_audio(spark, str(tmp_path))).first().duration_us == 62500
    raw = np.random.default_rng(0).normal(size=2000).astype("<f4")
    (tmp_path / "x.f32").write_bytes(raw.tobytes())
    spark.dataSource.register(pcm.RawSamples)
    rows = spark.read.format("pcm_f32le").options(rate=8000, channels=2, chunk=100, chunks_per_task=3).load(f"{tmp_path}/x.f32").orderBy("chunk_no").collect()
    assert np.array_equal(np.concatenate([r.samples for r in rows]).astype("<f4"), raw) and len(rows) == 10


def test_streaming_overlap_add_equals_batch(spark, tmp_path):
    from ostinato.operators import overlap

    values = [(k, at + i, i, float(at * 3 + i)) for k in ("a", "b") for at in range(0, 70, 7) for i in range(10)]
    shape = "k string, frame long, i long, v double"
    df = spark.createDataFrame(values, shape)
    want = sorted((r.k, r.frame, round(r.v, 9)) for r in overlap.overlap_add(df, ["k"], "frame", "i", "v", 10).collect())
    last = df.groupBy("k").agg(F.max("frame").alias("frame"), F.max("i").alias("i"), F.max("v").alias("v")).select("k", "frame", "i", "v")
    df.unionByName(stream.closing(last, "frame", "i", "v", 10)).orderBy("frame").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
    q = stream.overlap_add(source, ["k"], "frame", "i", "v", 10).writeStream.format("memory").queryName("ola").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.frame, round(r.v, 9)) for r in spark.table("ola").collect()) == want


def test_streaming_energy(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = stream.energy(source.withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "ts", "value", "1 day").writeStream.format("memory").queryName("en").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.event_type, r.begin): round(r.energy, 6) for r in spark.table("en").collect()}
    batch = events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("e")).collect()
    want = {(r.event_type, r.w.start): round(r.e, 6) for r in batch}
    assert got and all(want[k] == v for k, v in got.items())


def test_convert(spark):
    t = np.arange(44100) / 44100
    x = np.zeros(44100, np.float32)
    for at in range(4410, 40000, 8820):
        x[at : at + 2205] = np.sin(2 * np.pi * 60 * t[:2205])
    both = chunks(spark, x, stem="drums").unionByName(chunks(spark, np.sin(2 * np.pi * 220 * t), stem="bass"))

    def activate(df):
        row = F.transform(F.sequence(F.lit(0), F.lit(87)), lambda k: F.when((k == 20) & (F.col("t") >= 5) & (F.col("t") < 30), 0.8).otherwise(0.0).cast("float"))
        on = F.transform(F.sequence(F.lit(0), F.lit(87)), lambda k: F.when((k == 20) & (F.col("t") == 5), 0.9).otherwise(0.0).cast("float"))
        return df.select("track_id", "stem").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(49)))).select("track_id", "stem", "t", row.alias("frame"), on.alias("onset"))

    notes, parts, tempo = convert.analyze(both, convert.Models(separate=lambda df: df, activate=activate), chunk=1 << 14)
    got = parts.collect()
    assert {r.stem: (r.program, r.drum) for r in got} == {"bass": (33, False), "drums": (0, True)}
    assert notes.filter("stem = 'bass'").count() == 1 and notes.filter("stem = 'drums'").count() >= 3
    _, events = midi.parse(convert.write(notes, convert.review(parts), tempo, 1).first().content)
    assert {e[2] for e in events} == {"TEMPO", "PROGRAM", "ON", "OFF"}
    assert convert.write_stems(notes, parts, tempo).count() == 2


def test_windowed_model_and_velocities(spark, tmp_path):
    """A model that hears a note wherever a window's samples are loud; the note is as loud as its samples, whatever the model says."""
    n = 22050 * 5
    x = np.zeros(n, np.float32)
    x[11025 : 11025 * 3], x[11025 * 5 : 11025 * 7] = 0.25, 0.5
    audio = chunks(spark, x, rate=22050, stem="bass").unionByName(chunks(spark, np.full(n, 0.2), rate=22050, stem="vocals"))  # quieter, so that the bass isn't balanced down

    def activate(df):
        frames = F.explode(F.sequence(F.lit(0), F.lit(171))).alias("f")
        loud = F.abs(F.get("samples", F.least(F.col("f") * 256, F.lit(43843)))) > 0.1
        said = df.filter("stem = 'bass'").select("track_id", "stem", "window_no", frames, "samples").select("track_id", "stem", "window_no", "f", loud.alias("loud"))
        row = lambda v: F.transform(F.sequence(F.lit(0), F.lit(87)), lambda k: F.when((k == 30) & F.col("loud"), v).otherwise(0.0).cast("float"))
        return said.select("track_id", "stem", "window_no", "f", row(0.9).alias("frame"), row(0.0).alias("onset"))

    matrix = convert.matrix_of(convert.mono_at(audio), activate)
    assert [r.t for r in matrix.select("t").orderBy("t").collect()] == list(range(n * 86 // 22050))
    notes, parts, tempo = convert.analyze(audio, convert.Models(separate=lambda df: df, activate_windows=activate))
    got = notes.filter("stem = 'bass'").orderBy("start_tick").collect()
    assert [r.velocity for r in got] == [64, 127]  # peaks of 0.25 and 0.5 against the stem's 0.5
    assert [r.pitch for r in got] == [51, 51] and abs(got[0].start_tick - 480) < 40 and abs(got[1].start_tick - 2400) < 40
    convert.save(f"{tmp_path}/kept", notes, parts, tempo, {"bpm": "auto"})
    again = convert.load(spark, f"{tmp_path}/kept")
    assert all(sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) for a, b in zip(again, (notes, parts, tempo))) and again[3] == {"bpm": "auto"}


def test_stems_of_several_tracks_keep_apart(spark, tmp_path):
    notes = spark.createDataFrame([(t, s, 0, 0, 240, p, 100) for t, s, p in (("a", "drums", 36), ("b", "drums", 38), ("b", "bass", 40))], NOTES)
    parts = spark.createDataFrame([("a", "drums", 0, 0, True), ("b", "bass", 0, 33, False), ("b", "drums", 1, 0, True)], PARTS)
    files = convert.write_stems(notes, parts, spark.createDataFrame([("a", 120), ("b", 90)], "track_id string, bpm int"))
    midi.save(files, f"{tmp_path}/out")
    found = {str(p.relative_to(f"{tmp_path}/out")): p.read_bytes() for p in (tmp_path / "out").rglob("*.mid")}
    assert sorted(found) == ["a/drums.mid", "b/bass.mid", "b/drums.mid"] and len(set(found.values())) == 3
    with pytest.raises(ValueError):
        midi.save(files.unionByName(files), f"{tmp_path}/twice")
    assert not (tmp_path / "twice").exists()
    assert stores.relative("file:/x//y.wav") == "x/y.wav"
    for bad in ("../x", "/", "a/../../b"):
        with pytest.raises(ValueError):
            stores.relative(bad)


def test_raw_samples_written_and_class_map(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=3000).astype("<f4")
    pcm.save_raw(chunks(spark, x, channels=2, chunk=100).unionByName(chunks(spark, -x, channels=2, chunk=100, track="b")), f"{tmp_path}/raw", ("track_id", "stem"))
    assert (tmp_path / "raw/a/drums.f32").read_bytes() == x.tobytes() and (tmp_path / "raw/b/drums.f32").read_bytes() == (-x).tobytes()
    rows = spark.read.format("pcm_f32le").options(rate=8000, channels=2, chunk=64).load(f"{tmp_path}/raw").filter("track_id LIKE '%/b/%'").orderBy("chunk_no").collect()
    assert np.array_equal(np.concatenate([r.samples for r in rows]).astype("<f4"), -x)
    (tmp_path / "c.csv").write_text('index,mid,display_name\n0,/m/a,Speech\n1,/m/b,"Child, kid ""x"""\n')
    assert [tuple(r) for r in pcm.class_map(spark, f"{tmp_path}/c.csv").orderBy("index").collect()] == [(0, "/m/a", "Speech"), (1, "/m/b", 'Child, kid "x"')]


def test_other_decoders_take_audio_by_its_endings(spark, tmp_path):
    for name in ("a.mp3", "b.flac", "c.mid", "d.txt"):
        (tmp_path / name).write_bytes(b"xx")
    rows = pcm.read_audio(spark, str(tmp_path), decode=lambda data: (8000, 1, np.ones(len(data), np.float32))).collect()
    assert sorted(r.track_id.rsplit("/", 1)[-1] for r in rows) == ["a.mp3", "b.flac"]


def test_a_place_outside_its_segment_fails_the_stream(spark, tmp_path):
    shape = "k string, frame long, i long, v double"
    spark.createDataFrame([("a", 0, 0, 1.0), ("a", 30, 12, 1.0)], shape).write.parquet(f"{tmp_path}/in")
    q = stream.overlap_add(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), ["k"], "frame", "i", "v", 10).writeStream.format("memory").queryName("bad").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="outside the segment"):
        q.awaitTermination(120)


def test_empty_audio_keeps_the_default_instrument(spark):
    empty = spark.createDataFrame([("a", "bass", 0, 0, 44100, 1, [])], chunks(spark, np.zeros(1)).schema)
    both = empty.unionByName(chunks(spark, np.full(4410, 0.5), stem="guitar"))
    tag = lambda df: df.select("track_id", "stem").distinct().withColumn("class", F.lit(148)).withColumn("score", F.lit(0.9))
    _, parts, _ = convert.analyze(both.unionByName(chunks(spark, np.full(10, 0.5), track="b", stem="bass")), convert.Models(separate=lambda df: df, tag=tag))
    got = {(r.track_id, r.stem): (r.program, r.confidence) for r in parts.collect()}
    assert got[("a", "guitar")] == (0, 0.9) and got.get(("a", "bass"), (33, None)) == (33, None)

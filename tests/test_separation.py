import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import separation, stems, tagging
from ostinato.plans import convert
from ostinato.sources import midi, pcm

from .test_operators import pcm as chunks

T = ["track_id"]


def whole(x, model, segment, stride, sources):
    """Overlap-add over the whole signal (frames, channels): each slice in the middle of its segment, weighted by a triangle."""
    n, half = len(x), segment // 2
    weight = np.array([(i + 1 if i < half else segment - i) / max(half, segment - half) for i in range(segment)])
    total, weights = np.zeros((sources, n, x.shape[1])), np.zeros(n)
    for at in range(0, n, stride):
        valid = min(segment, n - at)
        lead = (segment - valid) // 2
        padded = np.zeros((segment, x.shape[1]))
        for i in range(segment):
            if 0 <= at - lead + i < n:
                padded[i] = x[at - lead + i]
        found = model(padded.T).transpose(0, 2, 1)
        total[:, at : at + valid] += (found * weight[:, None])[:, lead : lead + valid]
        weights[at : at + valid] += weight[lead : lead + valid]
    return total / np.maximum(weights, 1e-8)[:, None]


def joined(df, stem):
    rows = df.filter(F.col("stem") == stem).orderBy("start").collect()
    assert [r.start for r in rows] == [r.chunk_no * 16 for r in rows]
    return np.concatenate([np.array(r.samples, np.float32).reshape(-1, r.channels) for r in rows])


@pytest.mark.parametrize("n", [1, 5, 10, 25, 47, 200])
@pytest.mark.parametrize("cut", [3, 64])
def test_separation_equals_the_whole_signal(spark, n, cut):
    """Slices, outputs and stems from chunks of any length, against one array; the model sees where in its segment it is."""
    x = np.random.default_rng(n).normal(size=(n, 2)).astype(np.float32)

    def model(y):
        place = np.arange(y.shape[1])
        return np.stack([y * (k + 1) + place * 0.1 * k for k in range(3)])

    df = chunks(spark, x.ravel(), channels=2, chunk=cut).drop("stem").repartition(3)
    got = separation.separated(df, separation.each_slice(model), T, ("a", "b", "c"), 10, chunk=16)
    want = whole(x, model, 10, 7, 3)
    for k, stem in enumerate("abc"):
        assert np.abs(joined(got, stem) - want[k]).max() < 1e-5


def test_a_model_that_copies_gives_the_input_back(spark):
    x = np.random.default_rng(1).normal(size=(1000, 2)).astype(np.float32)
    df = chunks(spark, x.ravel(), channels=2, chunk=77).drop("stem")
    two = df.unionByName(df.withColumn("track_id", F.lit("b")).filter("start < 500"))
    got = separation.separated(two, separation.each_slice(lambda y: np.stack([y] * 6)), segment=64, chunk=16)
    assert {r.stem for r in got.select("stem").distinct().collect()} == set(separation.SOURCES)
    assert np.abs(joined(got.filter("track_id = 'a'"), "piano") - x).max() < 1e-6
    assert np.abs(joined(got.filter("track_id = 'b'"), "drums") - x[:539]).max() < 1e-6
    assert separation.separated(df.filter("1 = 0"), separation.each_slice(lambda y: np.stack([y] * 6)), segment=64).count() == 0
    silent = df.withColumn("samples", F.array().cast("array<float>"))
    assert separation.separated(silent, separation.each_slice(lambda y: np.stack([y] * 6)), segment=64).count() == 0


def test_an_output_of_another_length_fails(spark):
    df = chunks(spark, np.zeros(40), channels=2, chunk=20).drop("stem")
    with pytest.raises(Exception, match="the model gave"):
        separation.separated(df, separation.each_slice(lambda y: y), segment=16).collect()


def test_weights_are_those_of_the_reference_values():
    assert np.allclose(separation.triangle(10), [0.2, 0.4, 0.6, 0.8, 1, 1, 0.8, 0.6, 0.4, 0.2])


def test_pooled_scores_are_means_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(tagging, "_OPEN", 3)
    r = np.random.default_rng(3)
    x = r.random((400, 12)).astype(np.float32)
    rows = [(f"t{k % 7}" if k % 7 else None, v.tolist()) for k, v in enumerate(x)] + [("t1", None), ("t9", [0.5])]
    df = spark.createDataFrame(rows, "track_id string, scores array<float>").repartition(6)
    got = {r.track_id: (r.n, r.means) for r in tagging.pooled(df, T).collect()}
    for k in range(7):
        n, means = got[f"t{k}" if k else None]
        assert n == len(x[k::7]) and np.abs(np.array(means) - x[k::7].astype(float).mean(0)).max() < 1e-9
    assert got["t9"] == (1, [0.5]) and tagging.pooled(df.filter("1 = 0"), T).count() == 0
    mixed = spark.createDataFrame([("a", [1.0, 1.0]), ("a", [1.0])], "track_id string, scores array<float>")
    assert tagging.pooled(mixed, T).first().means == [1.0, 0.5]


def scores(**own):
    v = [0.0] * tagging.CLASSES
    for c, x in own.items():
        v[int(c[1:])] = x
    return v


def test_ties_go_to_the_later_entry(spark):
    """Class 164 is listed behind 171, so it wins a tie; what isn't mapped never wins; the limit itself is enough."""
    rows = [("tie", scores(c164=0.3, c171=0.3)), ("over", scores(c164=0.3, c171=0.31)), ("music", scores(c132=0.9, c137=0.2)), ("limit", scores(c137=0.05)), ("under", scores(c137=0.0499)), ("short", [0.9] * 20)]
    df = spark.createDataFrame(rows, "track_id string, scores array<float>")
    got = {r.track_id: r["class"] for r in tagging.tags(df, T).collect()}
    assert got == {"tie": 164, "over": 171, "music": 137, "limit": 137}
    zero = tagging.best_tag(tagging.pooled(df.filter("track_id = 'short'"), T), T, 0.0)
    assert zero.first()["class"] == stems.CLASS_PROGRAMS[-1][0]  # all score 0


def test_analysis_with_both_models(spark, tmp_path):
    """From a stereo file to instruments: slices are separated and blended, patches pooled, ties settled."""
    rate = 44_100
    t = np.arange(rate * 2) / rate
    x = np.zeros(len(t))
    for at in range(4410, len(t) - 3000, 8820):
        x[at : at + 2205] += np.sin(2 * np.pi * 60 * t[:2205])
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as file:
        file.setparams((2, 2, rate, 0, "NONE", ""))
        file.writeframes((np.repeat(x * 0.5, 2) * 32767).astype("<i2").tobytes())
    (tmp_path / "x.wav").write_bytes(buffer.getvalue())
    song = pcm.read_wav(spark, str(tmp_path), chunk=5000, bytes_per_task=40_000)
    assert song.rdd.getNumPartitions() > 5

    def split(y):
        hum = np.broadcast_to(0.3 * np.sin(np.arange(y.shape[1]) / 30), y.shape)
        return np.stack([y, hum, hum * 0.9, hum * 0, hum * 0.8, hum * 0.001])

    seen = {"bass": scores(c164=0.3, c171=0.3), "other": scores(c153=0.9), "guitar": scores(c143=0.4)}

    def tag(rows):
        own = F.when(F.col("stem") == "bass", F.array(*map(F.lit, seen["bass"])))
        own = own.when(F.col("stem") == "other", F.array(*map(F.lit, seen["other"]))).when(F.col("stem") == "guitar", F.array(*map(F.lit, seen["guitar"])))
        assert {f.name for f in rows.schema} == {"track_id", "stem", "window_no", "samples"}
        return rows.filter("size(samples) = 15600").select("track_id", "stem", own.cast("array<float>").alias("scores"))

    models = convert.Models(separate_slices=separation.each_slice(split), segment=20_000, tag_patches=tag)
    notes, parts, tempo = convert.analyze(song, models, chunk=1 << 14)
    got = {r.stem: (r.program, r.drum, r.confidence and round(r.confidence, 4)) for r in parts.collect()}
    # 164 is timpani; the generic synth falls back; silent stems are gone
    assert got == {"drums": (0, True, None), "bass": (47, False, 0.3), "other": (0, False, None), "guitar": (104, False, 0.4)}
    assert notes.filter("stem = 'drums'").count() >= 6
    kinds = {e[2] for e in midi.parse(convert.write(notes, parts, tempo, 1).first().content)[1]}
    assert {"ON", "OFF", "TEMPO"} <= kinds
    plain = convert.stems_of(song, models, 1 << 14, rate).filter("stem = 'drums'").orderBy("start").collect()
    back = np.concatenate([r.samples for r in plain])
    assert np.abs(back - np.repeat(x * 0.5, 2)).max() < 1e-3


def wav_bytes(x, width, rate=8000, form="RIFF", extensible=False, real=False, odd=False):
    raw = x.astype(f"<f{width}" if real else {1: "u1", 2: "<i2", 4: "<i4"}[width]).tobytes()
    kind = 3 if real else 1
    shape = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, x.shape[1], rate, rate * width * x.shape[1], width * x.shape[1], 8 * width)
    if extensible:
        shape += struct.pack("<HHI", 22, 8 * width, 0) + struct.pack("<H", kind) + bytes(14)
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0" if odd else b""
    size = 0xFFFFFFFF if form == "RF64" else len(raw)
    large = b"ds64" + struct.pack("<I", 28) + struct.pack("<QQQI", 0, len(raw), len(x), 0) if form == "RF64" else b""
    return form.encode() + struct.pack("<I", 0xFFFFFFFF if large else 36 + len(raw)) + b"WAVE" + large + extra + b"fmt " + struct.pack("<I", len(shape)) + shape + b"data" + struct.pack("<I", size) + raw + b"tail"


@pytest.mark.parametrize("kind", ["plain", "rf64", "extensible", "float", "bytes", "wide"])
def test_wav_ranges_equal_whole_files(spark, tmp_path, kind):
    r = np.random.default_rng(7)
    width = {"float": 4, "bytes": 1, "wide": 4}.get(kind, 2)
    x = r.normal(size=(1003, 2)) if kind == "float" else r.integers(0, 256, (1003, 2)) if kind == "bytes" else r.integers(-30000, 30000, (1003, 2))
    data = wav_bytes(x, width, form="RF64" if kind == "rf64" else "RIFF", extensible=kind == "extensible", real=kind == "float", odd=kind == "plain")
    for name in ("a.wav", "B.WAV", "c.txt"):
        (tmp_path / name).write_bytes(data)
    want = x if kind == "float" else (x - 128) / 128 if kind == "bytes" else x / 2.0 ** (8 * width - 1)
    for step in (100, 777, 1 << 20):
        df = pcm.read_wav(spark, str(tmp_path), chunk=64, bytes_per_task=step)
        rows = df.orderBy("track_id", "chunk_no").collect()
        assert [r.chunk_no for r in rows] == [*range(16)] * 2 and rows[1].start == 64 and rows[0].sample_rate == 8000
        for own in (rows[:16], rows[16:]):
            assert np.allclose(np.concatenate([r.samples for r in own]), want.ravel(), atol=1e-6)
    if kind in ("bytes", "wide"):
        again = pcm.read_audio(spark, str(tmp_path), chunk=64, glob="a.wav").orderBy("chunk_no").collect()
        assert [r.samples for r in again] == [r.samples for r in rows[:16]]


def test_a_large_wav_is_many_tasks(tmp_path):
    """Four GB that are never written: only the header is, and a task reads its own range."""
    x = np.zeros((10, 2), np.int16)
    head = wav_bytes(x, 2)[: -len(b"tail") - 40]
    with open(tmp_path / "x.wav", "wb") as file:
        file.write(head[:-4] + struct.pack("<I", 4_000_000_000))
        file.truncate(4_000_000_000 + len(head))
    reader = pcm._WavReader({"path": str(tmp_path)})
    tasks = reader.partitions()
    assert len(tasks) == 60
    rows = [b for b in reader.read(tasks[30])]
    assert 200 < len(rows) < 300 and sum(len(b.column(5)[0]) for b in rows) * 2 <= (64 << 20) + (1 << 18)
    one, two = ([b.column(1)[0].as_py() for b in reader.read(tasks[k])] for k in (41, 42))
    assert two[0] == one[-1] + 1


def test_files_that_are_no_wav_fail_with_their_names(spark, tmp_path):
    for k, data in enumerate((b"nothing", b"RIFF\0\0\0\0WAVEfmt ", wav_bytes(np.zeros((3, 1), np.int16), 2).replace(struct.pack("<HH", 1, 1), struct.pack("<HH", 2, 1), 1))):
        folder = tmp_path / str(k)
        folder.mkdir()
        (folder / "bad.wav").write_bytes(data)
        with pytest.raises(Exception, match="bad.wav"):
            pcm.read_wav(spark, str(folder)).collect()

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.functions import numeric as N
from ostinato.operators import activations, joins, overlap, series, signal, stems, windows

K = ["track_id", "stem"]


def pcm(spark, x, rate=44100, channels=1, chunk=1 << 14, track="a", stem="drums"):
    x = np.asarray(x, np.float32)
    rows = [(track, stem, k, at, rate, channels, x[at * channels : (at + chunk) * channels].tolist()) for k, at in enumerate(range(0, len(x) // channels, chunk))]
    return spark.createDataFrame(rows, "track_id string, stem string, chunk_no long, start long, sample_rate int, channels int, samples array<float>")


def clicks(bpm, rate=44100, seconds=20, seed=7):
    r, x = np.random.default_rng(seed), np.zeros(rate * seconds, np.float32)
    n = rate // 100
    for k in range(int(seconds * bpm / 60)):
        at = int(k * 60 / bpm * rate)
        x[at : at + n] += (r.uniform(-1, 1, n) * np.exp(-np.arange(n) / (n / 4)))[: len(x) - at]
    return x


@pytest.mark.parametrize("bpm", [90, 120, 140, 174])
def test_tempo_of_clicks(spark, bpm):
    row = signal.tempo(pcm(spark, clicks(bpm)), K).first()
    assert abs(row.bpm - bpm) <= 2


def test_tempo_defaults(spark):
    assert signal.tempo(pcm(spark, np.zeros(100)), K).first().bpm == 120
    assert signal.tempo(pcm(spark, np.zeros(441000)), K).first().bpm == 120


def test_onsets_of_bursts(spark):
    r, x = np.random.default_rng(1), np.zeros(88200, np.float32)
    for at in (8820, 35280, 66150):
        x[at : at + 882] = r.uniform(-1, 1, 882)
    got = sorted(x.onset for x in signal.onsets(pcm(spark, x), K).collect())
    assert len(got) == 3 and all(abs(a - b) <= 512 for a, b in zip(got, (8820, 35280, 66150)))


def test_frames_do_not_depend_on_chunks(spark):
    x = np.random.default_rng(2).normal(size=30000)
    a, b = (sorted((r.frame, round(r.energy, 6)) for r in signal.frames(pcm(spark, x, chunk=c), K, 1024, 512).collect()) for c in (1 << 20, 2048))
    assert a == b and len(a) == (30000 - 1024) // 512 + 1


def test_drum_voices(spark):
    rate, t = 44100, np.arange(3528) / 44100
    r = np.random.default_rng(3)
    noise = r.uniform(-1, 1, 3528)
    high = np.diff(np.diff(np.diff(np.concatenate([[0, 0, 0], noise]))))
    low = np.convolve(noise, np.ones(24) / 24, "same")
    cases = {"kick": np.sin(2 * np.pi * 60 * t), "closed": high * np.exp(-t / 0.005), "open": high, "silence": np.zeros(3528), "snare": low - low.mean()}
    want = {"kick": 36, "closed": 42, "open": 46, "silence": 38, "snare": 38}
    rows = [(k, *signal.hit_features(x.astype(np.float32), rate, 1 << 40)) for k, x in cases.items()]
    got = spark.createDataFrame(rows, "name string, low double, high double, zcr double, decay double, peak double").withColumn("v", signal.voice()).collect()
    assert {r.name: r.v for r in got} == want


def test_drum_notes(spark):
    x = np.zeros(44100, np.float32)
    x[8820 : 8820 + 3528] = np.sin(2 * np.pi * 60 * np.arange(3528) / 44100)
    df = pcm(spark, x)
    rows = signal.drum_notes(df, K, spark.createDataFrame([("a", "drums", 120)], "track_id string, stem string, bpm int"), 1 << 14).collect()
    assert rows and all(40 <= r.velocity <= 127 and r.end_tick > r.start_tick for r in rows)


def test_resample_and_remix(spark):
    x = np.random.default_rng(4).normal(size=1000)
    got = signal.resample(pcm(spark, x, 44100, chunk=128), K, 22050).orderBy("start").collect()
    y = np.concatenate([r.samples for r in got])
    assert len(y) == 500 and np.allclose(y, x[::2], atol=1e-5)
    two = signal.remix(pcm(spark, x, channels=2), K, 1).orderBy("start").collect()
    assert np.allclose(np.concatenate([r.samples for r in two]), x.reshape(-1, 2).mean(1), atol=1e-5)


def test_placements_and_weights(spark):
    df = spark.createDataFrame([("a", 25), ("b", 5), ("c", 0)], "k string, n int")
    got = sorted(tuple(r) for r in overlap.placements(df, ["k"], "n", 10).collect())
    assert got == [("a", 0, 10, 0, 10, 0, 0), ("a", 7, 10, 7, 10, 0, 0), ("a", 14, 10, 14, 10, 0, 0), ("a", 21, 4, 18, 7, 0, 3), ("b", 0, 5, 0, 5, 2, 2)]
    w = [r[0] for r in spark.range(10).orderBy("id").select(overlap.weight(F.col("id"), 10)).collect()]
    assert w == [0.2, 0.4, 0.6, 0.8, 1.0, 1.0, 0.8, 0.6, 0.4, 0.2]


def golden(*bins):
    frame, onset = np.zeros((40, 88), np.float32), np.zeros((40, 88), np.float32)
    for b, hit, value, at, first, last in bins:
        if at is not None:
            onset[at, b] = hit
        frame[first : last + 1, b] = value
    return frame, onset


def test_decoding(spark):
    four = golden((10, 0.9, 0.6, 2, 2, 14), (20, 0.8, 0.5, 5, 5, 18), (30, 0.95, 0.7, 8, 8, 13), (40, 0.2, 0.6, 10, 10, 24))
    got = activations.decode(*four, leftover=False)
    assert [(a, b, c, round(d, 5)) for a, b, c, d in got] == [(2, 15, 31, 0.6), (5, 19, 41, 0.5), (10, 25, 61, 0.6)]
    three = golden((10, 0.9, 0.6, 2, 2, 14), (20, 0.8, 0.5, 5, 5, 18), (50, 0, 0.6, None, 0, 29))
    want = [(0, 29, 71, 0.6), (2, 15, 31, 0.6), (5, 19, 41, 0.5)]
    assert [(a, b, c, round(d, 5)) for a, b, c, d in activations.decode(*three)] == want
    rows = [("a", "bass", t, f.tolist(), o.tolist()) for t, (f, o) in enumerate(zip(*three))]
    df = spark.createDataFrame(rows, "track_id string, stem string, t int, frame array<float>, onset array<float>")
    assert sorted((r.start_frame, r.end_frame, r.pitch, round(r.amplitude, 5)) for r in activations.notes(df, K).collect()) == want
    assert activations.decode(np.zeros((0, 88)), np.zeros((0, 88))) == []


def test_frame_times(spark):
    want = {0: 0, 1: 0.01160998, 170: 1.97369615, 171: 1.98530612, 172: 1.98659002, 173: 1.9982, 199: 2.30005941}
    for r in spark.range(200).select("id", N.frame_seconds(F.col("id")).alias("s")).collect():
        if r.id in want:
            assert math.isclose(r.s, want[r.id], abs_tol=1e-6)


def test_rounding_and_vlq(spark):
    got = spark.createDataFrame([(0.5,), (2.5,), (-2.5,)], "x double").select(N.half_up(F.col("x"))).collect()
    assert [r[0] for r in got] == [1, 3, -2]
    got = spark.createDataFrame([(x,) for x in (0, 127, 128, 16383, 16384, 2097152)], "x long").select(N.vlq_hex(F.col("x"))).collect()
    assert [r[0] for r in got] == ["00", "7f", "8100", "ff7f", "818000", "81808000"]


def test_gate_and_scales(spark):
    rows = [("a", "bass", 0.13), ("a", "vocals", 0.11), ("a", "guitar", 0.043), ("a", "piano", 0.0012), ("b", "bass", 0.144), ("b", "piano", 0.035), ("c", "bass", 0.0), ("d", "bass", 0.10), ("d", "vocals", 0.05), ("d", "piano", 0.008)]
    df = spark.createDataFrame(rows, "track_id string, stem string, rms double")
    assert [(r.track_id, r.stem) for r in stems.silent(df, ["track_id"]).filter("silent").collect()] == [("a", "piano")]
    s = {(r.track_id, r.stem): round(r.scale, 6) for r in stems.velocity_scales(df, ["track_id"]).collect()}
    assert s[("a", "bass")] == 1 and s[("d", "vocals")] == 0.5 and s[("d", "piano")] == 0.35 and ("c", "bass") not in s


def test_roles(spark):
    def shape(name, starts, length, pitches):
        return [(name, k, s, s + length, p) for k, (s, p) in enumerate(zip(starts, pitches))]

    rows = [
        *shape("pad", [1.5 * k for k in range(4)], 2.0, [60] * 4), *shape("pluck", [0.25 * k for k in range(8)], 0.1, [72] * 8),
        *shape("lead", [0.55 * k for k in range(6)], 0.4, [67, 68, 69, 67, 68, 69]), *shape("bass", [1.5 * k for k in range(4)], 2.0, [36] * 4),
        *shape("tail", [0.25 * k for k in range(35)], 0.1, [36] * 20 + [84] * 15), *shape("few", [0.0, 1.0], 0.5, [60, 60]),
    ]
    df = spark.createDataFrame(rows, "k string, seq int, s double, e double, pitch int")
    got = {r.k: r.role for r in stems.roles(stems.note_shapes(df, ["k"], "s", "e", "pitch", "seq")).collect()}
    assert got == {"pad": "SUSTAINED_PAD", "pluck": "RHYTHMIC_PLUCK", "lead": "LEAD", "bass": "BASS", "tail": "BASS", "few": None}


def test_instruments(spark):
    rows = [("drums", False, 150, 0.3, 38), ("vocals", False, 153, 0.5, 81), ("other", False, 153, 0.5, 89), ("piano", False, 150, 0.3, None), ("bass", True, 150, 0.3, 38), ("guitar", False, 167, 0.5, None), ("flute", False, None, None, None)]
    df = spark.createDataFrame(rows, "label string, audio_empty boolean, class int, score double, role_program int")
    got = {r.label: (r.program, r.drum, r.confidence) for r in stems.instruments(df).collect()}
    assert got == {"drums": (0, True, None), "vocals": (85, False, None), "other": (89, False, None), "piano": (16, False, 0.3), "bass": (33, False, None), "guitar": (0, True, 0.5), "flute": (0, False, None)}


def test_class_ties_and_limits(spark):
    order = {c: k for k, (c, _) in enumerate(stems.CLASS_PROGRAMS)}
    rows = [("x", 148, 0.10), ("x", 150, 0.30), ("x", 24, 0.20), ("y", 148, 0.02), ("z", 137, 0.05), ("t", 164, 0.5), ("t", 171, 0.5)]
    df = spark.createDataFrame([(*r, order[r[1]]) for r in rows], "k string, cls int, score double, ord int")
    got = {r.k: r.cls for r in stems.best_class(df, ["k"], "cls", "score", 0.05, "ord").collect()}
    assert got == {"x": 150, "z": 137, "t": 164}


def test_spacing_is_the_ordered_fold(spark):
    r = np.random.default_rng(5)
    rows = [("k%d" % k, int(x)) for k in range(3) for x in r.integers(0, 3000, 700)]
    got = series.spacing(spark.createDataFrame(rows, "k string, x int"), ["k"], "x", 6).collect()
    want = []
    for k in {a for a, _ in rows}:
        last = None
        for x in sorted({b for a, b in rows if a == k}):
            if last is None or x - last >= 6:
                want.append((k, x))
                last = x
    assert sorted(map(tuple, got)) == sorted(want)


def test_joins_take_the_last_of_equal_times(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 0, 2), (None, 5, 3)], "k string, at int, id int")
    right = spark.createDataFrame([("a", 5, "x", 1), ("a", 5, "y", 2), ("a", 9, "z", 3)], "k string, at int, v string, seq int")
    assert {r.id: r.v for r in joins.as_of(left, right, ["k"], "at", "v", "seq").collect()} == {1: "y", 2: None, 3: None}


@pytest.mark.parametrize("batch", [7, 10_000])
def test_ordered_folds_over_batches(spark, batch):
    """Series go over several batches, keys may be null, and time grows with the length."""
    r = np.random.default_rng(8)
    rows = [(k, i, float(x)) for k in ("a", None, "b") for i, x in enumerate(r.normal(size=900))]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.k, r.i): r.smooth for r in series.one_pole(df, ["k"], "i", "x", 0.1, block=16).collect()}
        kept = {(r.k, r.i) for r in series.spacing(df.filter("i % 3 <> 1"), ["k"], "i", 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    y, last, want = 0.0, None, set()
    for k, i, x in rows:
        y = 0.1 * x + (0.0 if i == 0 else 0.9 * y)
        assert abs(got[k, i] - y) < 1e-9
        last = None if i == 0 else last
        if i % 3 != 1 and (last is None or i - last >= 4):
            want.add((k, i))
            last = i
    assert len(got) == len(rows) and kept == want


def test_model_windows(spark):
    x = np.random.default_rng(4).normal(size=100_000).astype(np.float32)
    got = {r.window_no: r.samples for r in windows.fixed(pcm(spark, x, chunk=1000), K).collect()}
    padded = np.concatenate([np.zeros(3840, np.float32), x])
    assert sorted(got) == list(range(-(-len(padded) // 36164)))
    for k, own in got.items():
        want = np.zeros(43844, np.float32)
        part = padded[k * 36164 : k * 36164 + 43844]
        want[: len(part)] = part
        assert np.array_equal(np.array(own, np.float32), want)
    assert windows.fixed(pcm(spark, x[:0]), K).count() == 0


def test_planar_slices(spark):
    x = np.random.default_rng(5).normal(size=2 * 53).astype(np.float32)
    totals = spark.createDataFrame([("a", "drums", 53)], "track_id string, stem string, n long")
    places = overlap.placements(totals, K, "n", 20)
    rows = {r.offset: r.samples for r in windows.planar(pcm(spark, x, channels=2, chunk=8), places, K, 20, 8).collect()}
    assert sorted(rows) == [0, 15, 30, 45]
    for p in places.collect():
        want = np.zeros((2, 20), np.float32)
        want[:, p.pad_left : p.pad_left + p.read_length] = x.reshape(-1, 2)[p.read_start : p.read_start + p.read_length].T
        assert np.array_equal(np.array(rows[p.offset], np.float32), want.ravel())


def test_peaks_of_spans(spark):
    x = np.random.default_rng(6).normal(size=1000).astype(np.float32)
    spans = [("a", "drums", b, e) for b, e in ((0, 1), (5, 5), (99, 101), (3, 998), (100, 200), (990, 1000), (3, 998))]
    df = spark.createDataFrame(spans, "track_id string, stem string, b long, e long")
    got = windows.span_peaks(pcm(spark, x, chunk=100), df, K, "b", "e", 100).collect()
    assert len(got) == len(spans) and all(abs(r.peak - np.abs(x[r.b : r.e]).max(initial=0)) < 1e-9 for r in got)

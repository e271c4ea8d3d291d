"""Decoding between silences, ranges of unlike widths, sample ranges, names, and cases at the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import activations, joins, series, stems
from ostinato.plans import convert
from ostinato.sources import midi, pcm

K = ["track_id", "stem"]


def song(seed, n=1500, bins=12):
    """Bursts of notes between silences of all lengths, with murmurs below the limit, and onsets that begin in a silence."""
    r = np.random.default_rng(seed)
    frame, onset = r.random((n, bins)) * 0.28, r.random((n, bins)) * 0.45
    at = int(r.integers(0, 40))
    while at < n:
        length = int(r.integers(5, 120))
        for _ in range(int(r.integers(1, 9))):
            f, t, m = int(r.integers(0, bins)), at + int(r.integers(0, length)), int(r.integers(3, 60))
            frame[t : min(t + m, at + length), f] = 0.3 + 0.7 * r.random()
            onset[max(0, min(t - int(r.integers(0, 14)), n - 1)), f] = 0.5 + 0.5 * r.random()
        at += length + int(r.choice([3, 11, 20, 24, 27, 28, 29, 30, 31, 40, 90]))
    return frame.astype(np.float32), onset.astype(np.float32)


def matrix(spark, songs):
    rows = [(k, "s", t, frame[t].tolist(), onset[t].tolist()) for k, (frame, onset) in songs.items() for t in range(len(frame))]
    return spark.createDataFrame(rows, "track_id string, stem string, t int, frame array<float>, onset array<float>").repartition(5)


def test_pieces_decode_to_what_the_whole_does(spark):
    songs = {f"t{k}": song(k, n) for k, n in enumerate((1500, 900, 700, 30, 2, 1))}
    songs["quiet"] = (np.full((300, 12), 0.1, np.float32), np.zeros((300, 12), np.float32))
    df = matrix(spark, songs)
    got = {}
    for r in activations.notes(df, K, whole_frames=20).collect():
        got.setdefault(r.track_id, []).append((r.start_frame, r.end_frame, r.pitch, round(r.amplitude, 5)))
    total = 0
    for k, (frame, onset) in songs.items():
        want = sorted((a, b, p, round(v, 5)) for a, b, p, v in activations.decode(frame, onset))
        assert sorted(got.get(k, [])) == want
        total += len(want)
    assert total > 80
    pieces = activations._pieces(df, K, 0.3, 20).groupBy("track_id").agg(F.countDistinct("_piece").alias("n")).collect()
    assert {r.track_id: r.n for r in pieces}["t0"] > 5 and {r.track_id: r.n for r in pieces}["quiet"] == 1


@pytest.mark.parametrize("seed", range(12))
def test_a_cut_in_a_silence_changes_nothing(seed):
    """Without Spark: every silence that is cut, many songs."""
    frame, onset = song(seed + 100, 800)
    loud = np.flatnonzero((frame >= np.float32(0.3)).any(1))
    cuts = [int(a + (b - a) // 2) for a, b in zip(loud, loud[1:]) if b - a > activations.CUT_FRAMES]
    tops = float(onset.max()), float(activations.risen(frame).max())
    found = []
    for a, b in zip([0, *cuts], [*cuts, len(frame)]):
        halo = min(2, a)
        found += [(s + a, e + a, p, v) for s, e, p, v in activations.decode(frame[a - halo : b], onset[a - halo : b], tops=tops, halo=halo)]
    assert cuts and sorted(found) == activations.decode(frame, onset)


def test_regions_of_unlike_widths(spark):
    r = np.random.default_rng(1)
    regions = [(k, int(a), int(a + w)) for k, (a, w) in enumerate(zip(r.integers(-2000, 2000, 300), r.choice([0, 1, 3, 8, 9, 16, 17, 500, 100_000], 300)))] + [(900, 5, 4), (901, -(10**9), 10**9)]
    points = [(k, int(x)) for k, x in enumerate(r.integers(-3000, 3000, 500))]
    a, b = spark.createDataFrame(points, "p long, x long"), spark.createDataFrame(regions, "region long, lo long, hi long")
    got = sorted((g.p, g.region) for g in joins.in_regions(a, b, "x", "lo", "hi", 8).collect())
    assert got == sorted((p, k) for p, x in points for k, lo, hi in regions if lo <= x <= hi)
    assert joins.in_regions(a, b.filter("1 = 0"), "x", "lo", "hi", 8).count() == 0


def test_one_wide_range_among_many_narrow_ones_stays_linear(spark):
    narrow = spark.range(200_000).select(F.col("id").alias("region"), (F.col("id") * 50_000).alias("lo"), (F.col("id") * 50_000 + 9).alias("hi"))
    wide = spark.range(1).select(F.lit(-1).cast("long").alias("region"), F.lit(0).cast("long").alias("lo"), F.lit(10**10).alias("hi"))
    points = spark.range(1000).select((F.col("id") * 10_000_000 + 5).alias("x"))
    got = joins.in_regions(points, narrow.unionByName(wide), "x", "lo", "hi", 10)
    assert got.count() == 2000  # cells of ten would have made a thousand million rows of the wide one


def test_autocorrelation_over_blocks(spark):
    r = np.random.default_rng(2)
    at = np.flatnonzero(r.random(400) < 0.7)
    x = r.normal(size=len(at))
    df = spark.createDataFrame([("a", int(t), float(v)) for t, v in zip(at, x)] + [("b", -5, 2.0), ("b", 3, 3.0)], "k string, f long, v double").repartition(4)
    values = dict(zip(at.tolist(), x))
    want = {lag: sum(v * values[t + lag] for t, v in values.items() if t + lag in values) for lag in range(3, 30)}
    for block in (7, 64, 1 << 14):
        got = {(s.k, s.lag): s.score for s in series.autocorrelation(df, ["k"], "f", "v", 3, 29, block).collect()}
        assert all(abs(got["a", lag] - v) < 1e-9 for lag, v in want.items()) and got["b", 8] == 6.0 and len(got) == len(want) + 1


def test_scaled_and_tamed_samples(spark):
    df = spark.createDataFrame([([-32768, 0, 16384, 32767],)], "shorts array<smallint>")
    assert pcm.scaled(df).first().samples == pytest.approx([-1, 0, 0.5, 32767 / 32768])
    wild = spark.createDataFrame([([float("nan"), 4.0, -4.0, 4.01, float("inf"), -0.5],)], "samples array<float>")
    assert wild.select(pcm.tamed().alias("x")).first().x == pytest.approx([0, 4, -4, 0, 0, -0.5])


def test_program_names(spark):
    df = spark.createDataFrame([(k,) for k in (0, 33, 85, 127, 128, -1, None)], "program int")
    assert [r.program_name for r in stems.named(df).collect()] == ["Acoustic Grand Piano", "Electric Bass (finger)", "Lead 6 (voice)", "Gunshot", "Unknown", "Unknown", "Unknown"]
    assert len(stems.PROGRAM_NAMES) == len(set(stems.PROGRAM_NAMES)) == 128
    parts = spark.createDataFrame([("a", "bass", 0, 33, False), ("a", "piano", 1, 0, False)], "track_id string, stem string, ord int, program int, drum boolean")
    changes = spark.createDataFrame([("a", "piano", 200)], "track_id string, stem string, override int")
    assert {r.stem: r.program_name for r in convert.review(parts, None, changes).collect()} == {"bass": "Electric Bass (finger)", "piano": "Unknown"}


NOTES = "track_id string, stem string, seq long, start_tick long, end_tick long, pitch int, velocity int"
PARTS = "track_id string, stem string, ord int, program int, drum boolean"


def test_a_note_of_no_length_ends_before_it_starts(spark):
    notes = spark.createDataFrame([("a", "piano", 0, 480, 480, 60, 90)], NOTES)
    parts = spark.createDataFrame([("a", "piano", 0, 4, False)], PARTS)
    _, events = midi.parse(midi.files(notes, parts, spark.createDataFrame([("a", 120)], "track_id string, bpm int"), 0).first().content)
    assert [e[2] for e in events if e[2] in ("ON", "OFF")] == ["OFF", "ON"]


def test_a_tempo_of_nought_fails(spark):
    notes = spark.createDataFrame([("a", "piano", 0, 0, 480, 60, 90)], NOTES)
    parts = spark.createDataFrame([("a", "piano", 0, 4, False)], PARTS)
    with pytest.raises(Exception, match="(?i)zero"):
        midi.files(notes, parts, spark.createDataFrame([("a", 0)], "track_id string, bpm int"), 0).collect()


def test_more_than_fifteen_stems_share_channels(spark):
    rows = [("t", k, k == 3) for k in range(34)]
    got = {r.k: r.channel for r in stems.channels(spark.createDataFrame(rows, "t string, k int, drum boolean"), ["t"], "k", F.col("drum")).collect()}
    free = [c for c in range(16) if c != 9]
    assert got[3] == 9 and [got[k] for k in range(34) if k != 3] == [free[i % 15] for i in range(33)]


def test_a_generic_synth_gives_way(spark):
    rows = [("vocals", False, 153, 0.9, 81), ("guitar", False, 153, 0.9, None), ("guitar", False, 153, 0.9, 89), ("vocals", False, 24, 0.9, 81)]
    df = spark.createDataFrame(rows, "label string, audio_empty boolean, class int, score double, role_program int")
    assert [(r.program, r.confidence) for r in stems.instruments(df).collect()] == [(85, None), (25, None), (89, None), (85, 0.9)]


def test_a_short_chunk_in_the_middle_fails(spark):
    from ostinato.operators import signal

    rows = [("a", "s", k, at, 100, 1, [0.1] * n) for k, (at, n) in enumerate(((0, 8), (8, 2), (10, 8)))]
    df = spark.createDataFrame(rows, "track_id string, stem string, chunk_no long, start long, sample_rate int, channels int, samples array<float>")
    with pytest.raises(Exception, match="shorter than the reach of 4 frames follows chunk 0"):
        signal.with_halo(df, K, 4).collect()
    assert [len(r.halo) for r in signal.with_halo(df, K, 2).orderBy("chunk_no").collect()] == [2, 2, 0]
    assert [len(r.halo) for r in signal.with_halo(df.filter("chunk_no < 2"), K, 4).orderBy("chunk_no").collect()] == [2, 0]


def test_models_run_once(spark):
    """Stems are read by many steps, but the separation model sees each slice one time."""
    from ostinato.operators import separation

    from .test_operators import clicks, pcm as chunks

    seen = spark.sparkContext.accumulator(0)

    def split(y):
        seen.add(1)
        return np.stack([y] * 6)

    song = chunks(spark, np.repeat(clicks(120, seconds=2), 2), channels=2).drop("stem")
    notes, parts, tempo = convert.analyze(song, convert.Models(separate_slices=separation.each_slice(split), segment=40_000), chunk=1 << 14)
    assert parts.count() == 6 and notes.count() > 0 and tempo.count() == 1
    assert seen.value == 3

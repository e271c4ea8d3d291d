"""Series that are cut at ranges give what whole ones give, and no task has more than its share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import joins, ranges, series


def fold(xs, gap):
    kept = []
    for x in sorted(set(xs)):
        if not kept or x - kept[-1] >= gap:
            kept.append(x)
    return kept


@pytest.fixture()
def many(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("gap", [1, 6, 50, 100_000])
def test_spacing_by_ranges_is_the_fold(many, gap):
    r = np.random.default_rng(gap)
    rows = [("hot", int(x)) for x in r.integers(0, 9000, 3000)] + [("cold", int(x)) for x in r.integers(0, 900, 100)] + [(None, int(x)) for x in r.integers(0, 2000, 1500)] + [("hot", None)]
    df = many.createDataFrame(rows, "k string, x int").repartition(4)
    got = {}
    for row in series.spacing(df, ["k"], "x", gap, whole_rows=500).collect():
        got.setdefault(row.k, []).append(row.x)
    for k in ("hot", "cold", None):
        assert sorted(got[k]) == fold([x for a, x in rows if a == k and x is not None], gap)


def test_ways_through_a_stretch():
    r = np.random.default_rng(3)
    for n in (1, 2, 30, 200):
        own = np.unique(r.integers(0, 300, n))
        for gap in (1, 7, 40, 500):
            entry, end = series.exits(own, gap)
            for last in range(int(own[0]) - gap - 2, int(own[0])):
                kept = [x for x in fold([last, *own.tolist()], gap) if x != last]
                if last + gap <= own[-1]:
                    assert end[np.searchsorted(entry, last + gap)] == kept[-1]
                else:
                    assert not kept


def test_one_pole_by_ranges_is_the_fold(many):
    r = np.random.default_rng(1)
    rows = [(k, i, float(x)) for k, n in (("hot", 4000), ("cold", 50), (None, 1200)) for i, x in enumerate(r.normal(size=n))]
    got = {(x.k, x.i): x.smooth for x in series.one_pole(many.createDataFrame(rows, "k string, i long, v double").repartition(5), ["k"], "i", "v", 0.05, whole_rows=300).collect()}
    y = {}
    for k, i, x in rows:
        y[k] = y.get(k, 0.0) + 0.05 * (x - y.get(k, 0.0))
        assert abs(got[k, i] - y[k]) < 1e-9
    assert len(got) == len(rows)


def test_a_hot_series_is_many_tasks(many):
    df = many.range(20_000).select(F.lit("hot").alias("k"), "id", F.lit(1.0).alias("v"))
    rows = ranges.cut(df, ["k"], ["id"])
    sizes = [r["count"] for r in rows.groupBy(ranges.RANGE).count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 0.3 * 20_000


def test_as_of_by_ranges_equals_whole_keys(many):
    r = np.random.default_rng(2)
    left = [(k, int(t), i) for i, (k, t) in enumerate((r.choice(["hot", "hot", "hot", "cold", "only"]), r.integers(0, 5000)) for _ in range(4000))] + [(None, 5, 9999)]
    right = [(k, int(t), f"v{i}" if i % 7 else None, i) for i, (k, t) in enumerate((r.choice(["hot", "hot", "cold", "other"]), r.integers(0, 5000)) for _ in range(1500))]
    a = many.createDataFrame([(str(k) if k else None, t, i) for k, t, i in left], "k string, at int, id int")
    b = many.createDataFrame([(str(k), t, v, i) for k, t, v, i in right], "k string, at int, v string, seq int")
    whole = sorted(map(str, joins.as_of(a, b, ["k"], "at", "v", "seq").collect()))
    cut = sorted(map(str, joins.as_of(a, b, ["k"], "at", "v", "seq", whole_rows=300).collect()))
    assert whole == cut and len(whole) == len(left)
    marks = sorted((k, t, i, v) for k, t, v, i in right)
    for row in joins.as_of(a, b, ["k"], "at", "v", "seq", whole_rows=300).sample(0.05, 1).collect():
        before = [m for m in marks if m[0] == row.k and m[1] <= row.at]
        assert row.v == (max(before, key=lambda m: (m[1], m[2]))[3] if before else None)


def test_an_as_of_mark_of_null_hides_older_ones(many):
    a = many.createDataFrame([("k", t) for t in range(100)], "k string, at int")
    b = many.createDataFrame([("k", 10, "x", 1), ("k", 50, None, 2)], "k string, at int, v string, seq int")
    for most in (10, 10_000):
        got = {r.at: r.v for r in joins.as_of(a, b, ["k"], "at", "v", "seq", most).collect()}
        assert got[9] is None and got[10] == got[49] == "x" and got[50] is None and got[99] is None


def test_tempo_by_ranges_equals_whole_keys(many):
    r = np.random.default_rng(4)
    changes = [(str(k), int(t), int(m), i) for i, (k, t, m) in enumerate(zip(r.choice(["hot", "hot", "hot", "cold"], 2500), r.integers(0, 90_000, 2500), r.integers(200_000, 900_000, 2500)))]
    events = [(str(k), int(t), i) for i, (k, t) in enumerate(zip(r.choice(["hot", "cold", "none"], 2000), r.integers(0, 90_000, 2000)))]
    e, c = many.createDataFrame(events, "k string, tick long, id int"), many.createDataFrame(changes, "k string, tick long, micros long, seq long")
    whole = sorted(map(tuple, joins.tempo_ms(e, c, ["k"]).select("id", "ms").collect()))
    assert sorted(map(tuple, joins.tempo_ms(e, c, ["k"], whole_rows=200).select("id", "ms").collect())) == whole
    want = []
    for k, tick, i in events:
        total, at, micros = 0, 0, 500_000
        for _, t, m, _ in sorted((x for x in changes if x[0] == k), key=lambda x: (x[1], x[3])):
            if t > tick:
                break
            total, at, micros = total + (t - at) * micros, t, m
        want.append((i, int((total + (tick - at) * micros) / 1000.0 / 480)))
    assert whole == sorted(want)

"""Streams with keyed state give what batch gives."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ostinato.operators.separation import triangle
from ostinato.streaming import keyed


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    keyed.use_rocksdb(spark)
    yield spark
    spark.conf.set(key, before)


def second(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)


def run(spark, tmp_path, df, parts, name, build):
    """Rows of `df` in batches of files, by their column `file`; the result as a table."""
    for k in range(parts):
        df.filter(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.drop("file").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = build(source).writeStream.format("memory").outputMode("append").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.table(name).collect()


def test_ring_equals_one_sum(rocks, tmp_path):
    r, segment, rows, want = np.random.default_rng(1), 10, [], {}
    weight = triangle(segment)
    for key, total in (("a", 47), ("b", 25), ("c", 4)):
        sums, weights = np.zeros(total), np.zeros(total)
        for k, offset in enumerate(range(0, total, 7)):
            valid = min(segment, total - offset)
            trim = (segment - valid) // 2
            x = r.normal(size=valid)
            rows.append((key, second(k), offset, trim, x.tolist(), k))
            sums[offset : offset + valid] += weight[trim : trim + valid] * x
            weights[offset : offset + valid] += weight[trim : trim + valid]
        want[key] = sums / weights
    # one row of another key, far ahead, lets event time pass the last chunks; it is no part of theirs
    rows.append(("z", second(9000), 0, 0, [1.0] * 10, 7))
    rows.append(("z", second(9001), 7, 0, [1.0] * 10, 8))
    df = rocks.createDataFrame(rows, "key string, at timestamp, offset long, trim_start int, values array<double>, file int")
    got = run(rocks, tmp_path, df, 9, "ring", lambda s: keyed.overlap_add(s, ["key"], segment))
    for key, whole in want.items():
        own = sorted((x.begin, x.value) for x in got if x.key == key)
        assert [b for b, _ in own] == np.cumsum([0] + [len(v) for _, v in own])[:-1].tolist()
        assert np.allclose(np.concatenate([v for _, v in own]), whole)


def test_a_late_chunk_fails(rocks, tmp_path):
    rows = [("a", second(k), o, 0, [1.0] * 5, k) for k, o in enumerate((0, 8, 3))]
    df = rocks.createDataFrame(rows, "key string, at timestamp, offset long, trim_start int, values array<double>, file int")
    with pytest.raises(Exception, match="were final|outside"):
        run(rocks, tmp_path, df, 3, "late", lambda s: keyed.overlap_add(s, ["key"], 10))


def player(events):
    notes, programs, changes, out = set(), {}, [], []
    for seq, ms, channel, kind, data in events:
        silenced = 0
        if kind == "ON":
            notes.add((channel, data))
        elif kind == "OFF":
            notes.discard((channel, data))
        elif kind == "PROGRAM":
            programs[channel] = data
            changes.append((ms, channel, data))
        else:
            silenced, notes = len(notes), set()
            programs = {}
            for m, c, p in changes:
                if m <= ms:
                    programs[c] = p
        out.append((seq, kind, len(notes), silenced, programs.get(channel, 0)))
    return out


def test_sounding_notes_and_seeks_equal_a_replay(rocks, tmp_path):
    r, rows, want = np.random.default_rng(2), [], {}
    for key in ("a", "b"):
        events = []
        for seq in range(120):
            kind = str(r.choice(["ON", "ON", "OFF", "PROGRAM", "SEEK"], p=[0.3, 0.2, 0.35, 0.1, 0.05]))
            events.append((seq, int(r.integers(0, seq * 10 + 1)) if kind == "SEEK" else seq * 10, int(r.integers(0, 3)), kind, int(r.integers(60, 65))))
        want[key] = player(events)
        rows += [(key, *e, e[0] // 30) for e in events]
    df = rocks.createDataFrame(rows, "key string, seq long, ms long, channel int, type string, data int, file int")
    got = run(rocks, tmp_path, df, 4, "player", lambda s: keyed.sounding(s, ["key"]))
    for key, own in want.items():
        assert sorted((x.seq, x.type, x.sounding, x.silenced, x.program) for x in got if x.key == key) == own


def test_sessions_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    end = events.agg(F.max("ts").alias("t")).first().t
    closing = spark.createDataFrame([(-1, end + dt.timedelta(days=9))], "user_id long, ts timestamp")
    third = (F.ntile(3).over(Window.orderBy("ts")) - 1).alias("file")
    rows = events.select("user_id", "ts", third).unionByName(closing.withColumn("file", F.lit(3)))
    got = run(spark, tmp_path, rows, 4, "sessions", lambda s: keyed.sessions(s, ["user_id"], "ts"))
    batch = events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n").collect()
    assert sorted(tuple(x) for x in got if x.user_id != -1) == sorted(map(tuple, batch)) and len(batch) > 10

"""Queries that run the operators on the event tables, each with equivalent SQL.

A track is a user or an event type, an amplitude is a value (centred where its sign matters),
class scores are embeddings, and notes are a user's events in a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import joins, overlap, separation, series, stems, tagging, windows
from ..sources import pcm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 3_600_000_000
KEY = ["event_type"]


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def out(df: DataFrame, *columns: str) -> DataFrame:
    """The columns with whole numbers as longs and doubles to six places."""
    kinds = dict(df.dtypes)
    cast = {"int": "long", "smallint": "long", "tinyint": "long", "float": "double"}
    named = [F.col(c).cast(cast.get(kinds[c], kinds[c])) for c in columns]
    return df.select(*[F.round(x, 6).alias(c) if cast.get(kinds[c], kinds[c]) == "double" else x.alias(c) for x, c in zip(named, columns, strict=True)])


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.frame_energy(events(spark, sf_dir), KEY, F.floor(F.col("us") / HOUR).cast("long"), "value")


_ENERGY = f"WITH e AS (SELECT event_type, epoch_us(ts) // {HOUR} AS frame, sqrt(avg(value * value)) AS energy FROM events GROUP BY 1, 2)"
_FLUX = _ENERGY + ", f AS (SELECT *, coalesce(greatest(0, energy - lag(energy) OVER (PARTITION BY event_type ORDER BY frame)), 0) AS flux FROM e)"
_LEVEL = _FLUX + ", t AS (SELECT event_type, avg(flux) + 1.5 * stddev_pop(flux) AS threshold FROM f GROUP BY 1)"
_PEAKS = _LEVEL + """, n AS (SELECT f.*, threshold, lag(flux) OVER w AS a, lead(flux) OVER w AS b FROM f JOIN t USING (event_type) WINDOW w AS (PARTITION BY event_type ORDER BY frame)),
p AS (SELECT event_type, frame, flux FROM n WHERE flux > threshold AND flux >= a AND flux >= b)"""


def _spaced(source: str, gap: int, before: str) -> str:
    return f"""{before.replace("WITH ", "WITH RECURSIVE ", 1)}, k AS (SELECT event_type, frame, row_number() OVER (PARTITION BY event_type ORDER BY frame) AS i FROM (SELECT DISTINCT event_type, frame FROM {source})),
r AS (SELECT event_type, frame, i, frame AS kept, true AS ok FROM k WHERE i = 1
  UNION ALL SELECT k.event_type, k.frame, k.i, CASE WHEN k.frame - r.kept >= {gap} THEN k.frame ELSE r.kept END, k.frame - r.kept >= {gap} FROM r JOIN k ON k.event_type = r.event_type AND k.i = r.i + 1)
SELECT event_type, frame FROM r WHERE ok"""


@query(_ENERGY + " SELECT event_type, frame, round(energy, 6) AS energy FROM e")
def hourly_energy(spark, sf_dir):
    return out(hours(spark, sf_dir), "event_type", "frame", "energy")


def fluxes(spark, sf_dir):
    return series.flux(hours(spark, sf_dir), KEY, "frame")


@query(_FLUX + " SELECT event_type, frame, round(flux, 6) AS flux FROM f")
def hourly_flux(spark, sf_dir):
    return out(fluxes(spark, sf_dir), "event_type", "frame", "flux")


@query("WITH x AS (SELECT event_id, event_type, value, epoch_us(ts) // 3600000000 AS h FROM events) SELECT event_type, f AS frame, round(sqrt(avg(value * value)), 6) AS energy FROM x, (SELECT unnest(generate_series(0, 3)) AS k), LATERAL (SELECT h // 6 - k AS f) WHERE f >= 0 AND h < f * 6 + 24 GROUP BY 1, 2")
def hopping_energy(spark, sf_dir):
    """Frames of 24 hours, one every 6 hours."""
    rows = events(spark, sf_dir).withColumn("h", F.floor(F.col("us") / HOUR).cast("long"))
    return out(series.frame_energy(series.hopping(rows, "h", 24, 6, "hop"), KEY, F.col("hop"), "value"), "event_type", "frame", "energy")


@query(_LEVEL + " SELECT event_type, round(threshold, 6) AS threshold FROM t")
def flux_threshold(spark, sf_dir):
    return out(series.threshold(fluxes(spark, sf_dir), KEY), "event_type", "threshold").distinct()


def onsets(spark, sf_dir):
    return series.peaks(series.threshold(fluxes(spark, sf_dir), KEY), KEY, "frame")


@query(_PEAKS + " SELECT event_type, frame, round(flux, 6) AS flux FROM p")
def flux_peaks(spark, sf_dir):
    return out(onsets(spark, sf_dir), "event_type", "frame", "flux")


@query(_spaced("p", 6, _PEAKS))
def onset_spacing(spark, sf_dir):
    return out(series.spacing(onsets(spark, sf_dir), KEY, "frame", 6), "event_type", "frame")


@query(_spaced("u", 5, _PEAKS + ", l AS (SELECT event_type, epoch_us(ts) // 3600000000 AS frame FROM events WHERE value > 480 GROUP BY 1, 2), u AS (SELECT event_type, frame FROM p UNION SELECT * FROM l)"))
def onset_merge(spark, sf_dir):
    loud = events(spark, sf_dir).filter("value > 480").select("event_type", F.floor(F.col("us") / HOUR).cast("long").alias("frame"))
    return out(series.merge_onsets(onsets(spark, sf_dir), loud, KEY, "frame", 5), "event_type", "frame")


@query(_ENERGY + ", n AS (SELECT *, lag(energy) OVER w AS a, lead(energy) OVER w AS b FROM e WINDOW w AS (PARTITION BY event_type ORDER BY frame)) SELECT event_type, frame, round(energy, 6) AS energy FROM n WHERE energy > a AND energy > b")
def strict_peaks(spark, sf_dir):
    return out(series.strict_peaks(hours(spark, sf_dir), KEY, "frame", "energy"), "event_type", "frame", "energy")


@query(_FLUX + """, r AS (SELECT *, CASE WHEN lag(energy, 2) OVER w IS NULL THEN 0 ELSE greatest(0, least(energy - lag(energy, 1) OVER w, energy - lag(energy, 2) OVER w)) END AS rise FROM f WINDOW w AS (PARTITION BY event_type ORDER BY frame)),
m AS (SELECT event_type, max(flux) AS top, max(rise) AS most FROM r GROUP BY 1)
SELECT event_type, frame, round(greatest(flux, CASE WHEN most > 0 THEN rise * top / most ELSE 0 END), 6) AS inferred FROM r JOIN m USING (event_type)""")
def inferred_onsets(spark, sf_dir):
    return out(series.inferred_onsets(fluxes(spark, sf_dir), KEY, "frame", "flux", "energy"), "event_type", "frame", "inferred")


_LAGS = _FLUX + ", c AS (SELECT a.event_type, b.frame - a.frame AS lag, sum(a.flux * b.flux) AS score FROM f a JOIN f b ON a.event_type = b.event_type AND b.frame - a.frame BETWEEN {low} AND {high} GROUP BY 1, 2)"


@query(_LAGS.format(low=6, high=48) + " SELECT event_type, lag, round(score, 4) AS score FROM c")
def autocorr_lags(spark, sf_dir):
    found = series.autocorrelation(fluxes(spark, sf_dir), KEY, "frame", "flux", 6, 48)
    return found.select("event_type", F.col("lag").cast("long").alias("lag"), F.round("score", 4).alias("score"))


@query(_LAGS.format(low=14, high=48) + """, s AS (SELECT *, score * exp(-pow(log2(2880.0 / lag / 120), 2) / 0.98) AS biased FROM c),
b AS (SELECT event_type, lag AS best, score AS top FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY biased DESC, lag) AS k FROM s) WHERE k = 1),
p AS (SELECT b.event_type, CASE WHEN coalesce(s.score >= 0.6 * top, false) THEN floor(best / 1.5 + 0.5) ELSE best END AS best FROM b LEFT JOIN s ON s.event_type = b.event_type AND s.lag = floor(best / 1.5 + 0.5)),
q AS (SELECT p.event_type, best, coalesce(max(biased) FILTER (lag = best - 1), 0) AS a, max(biased) FILTER (lag = best) AS m, coalesce(max(biased) FILTER (lag = best + 1), 0) AS c FROM p JOIN s USING (event_type) GROUP BY 1, 2)
SELECT event_type, CAST(best AS BIGINT) AS best_lag, CAST(floor(least(200, greatest(60, 2880.0 / (best + CASE WHEN a - 2 * m + c <> 0 THEN 0.5 * (a - c) / (a - 2 * m + c) ELSE 0 END))) + 0.5) AS BIGINT) AS bpm FROM q""")
def best_period(spark, sf_dir):
    return out(series.tempo(fluxes(spark, sf_dir), KEY, "frame", rate=48.0), "event_type", "best_lag", "bpm")


@query("WITH c AS (SELECT user_id, ts, value - 100 >= 0 AS s FROM events), t AS (SELECT user_id, s <> lag(s) OVER (PARTITION BY user_id ORDER BY ts) AS turn FROM c) SELECT user_id, round(CASE WHEN count(*) > 1 THEN count(*) FILTER (turn) / (count(*) - 1) ELSE 0 END, 6) AS zcr FROM t GROUP BY 1")
def zero_crossing(spark, sf_dir):
    centred = events(spark, sf_dir).withColumn("value", F.col("value") - 100)
    return out(series.zero_crossing(centred, ["user_id"], "us", "value"), "user_id", "zcr")


_STEMS = "WITH s AS (SELECT user_id, event_type, sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak FROM events GROUP BY 1, 2), g AS (SELECT *, max(rms) OVER (PARTITION BY user_id) AS top FROM s)"


def loud(spark, sf_dir):
    return stems.loudness(events(spark, sf_dir), ["user_id", "event_type"], "value")


@query(_STEMS + " SELECT user_id, event_type, round(rms, 6) AS rms, round(peak, 6) AS peak FROM s")
def peak_rms_by_stem(spark, sf_dir):
    return out(loud(spark, sf_dir), "user_id", "event_type", "rms", "peak")


@query(_STEMS + " SELECT user_id, event_type, rms < 0.25 * top AND top > 0 AS silent FROM g")
def silence_gate(spark, sf_dir):
    return out(stems.silent(loud(spark, sf_dir), ["user_id"], 0.25), "user_id", "event_type", "silent")


@query(_STEMS + " SELECT user_id, event_type, round(least(1, greatest(0.35, rms / top)), 6) AS scale FROM g WHERE top > 0")
def velocity_scale(spark, sf_dir):
    return out(stems.velocity_scales(loud(spark, sf_dir), ["user_id"]), "user_id", "event_type", "scale")


@query(_STEMS + " SELECT event_id, CASE WHEN event_type = 'error' THEN 40 + event_id % 88 ELSE CAST(greatest(1, least(127, floor((40 + event_id % 88) * least(1, greatest(0.35, rms / top)) + 0.5))) AS BIGINT) END AS velocity FROM events JOIN g USING (user_id, event_type)")
def balanced_velocity(spark, sf_dir):
    """Errors stand for drums, which keep their velocity."""
    notes = events(spark, sf_dir).select("event_id", "user_id", "event_type", (40 + F.col("event_id") % 88).alias("velocity"))
    scales = stems.velocity_scales(loud(spark, sf_dir), ["user_id"]).filter("event_type <> 'error'")
    return out(stems.balanced(notes, scales, ["user_id", "event_type"]), "event_id", "velocity")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1")
def stem_included(spark, sf_dir):
    keep = spark.createDataFrame([("click",), ("view",), ("purchase",)], "event_type string")
    return events(spark, sf_dir).join(keep, "event_type", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error') GROUP BY 1")
def stem_excluded(spark, sf_dir):
    drop = spark.createDataFrame([("error",)], "event_type string")
    return events(spark, sf_dir).join(drop, "event_type", "left_anti").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH l(label, i) AS (VALUES ('drums', 0), ('bass', 1), ('vocals', 2), ('guitar', 3), ('piano', 4), ('flute', 5)), d(label, p, drum) AS (VALUES ('drums', 0, true), ('bass', 33, false), ('vocals', 85, false), ('guitar', 25, false), ('piano', 0, false), ('other', 0, false)),
s AS (SELECT DISTINCT user_id, label FROM events JOIN l ON i = event_id % 6), x AS (SELECT user_id, label, arg_max(event_id % 128, event_id) AS o FROM events JOIN l ON i = event_id % 6 WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT user_id, label, CAST(coalesce(o, p, 0) AS BIGINT) AS program, coalesce(drum, false) AS drum FROM s LEFT JOIN x USING (user_id, label) LEFT JOIN d USING (label)""")
def program_override(spark, sf_dir):
    """A user's events are stems by id; the last purchase in a stem overrides the program of its label."""
    labels = F.array(*map(F.lit, ("drums", "bass", "vocals", "guitar", "piano", "flute")))
    rows = table(spark, sf_dir, "events").withColumn("label", F.get(labels, (F.col("event_id") % 6).cast("int")))
    given = rows.filter("event_type = 'purchase'").groupBy("user_id", "label").agg(F.max_by(F.col("event_id") % 128, "event_id").alias("override"))
    own = stems.defaults(rows.select("user_id", "label").distinct())
    return out(stems.overridden(own, given, ["user_id", "label"]), "user_id", "label", "program", "drum")


@query("SELECT p.event_id, p.user_id, c.event_id AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts")
def asof_state(spark, sf_dir):
    every = events(spark, sf_dir)
    clicks = every.filter("event_type = 'click'").select("user_id", "us", F.col("event_id").alias("last_click"))
    rows = every.filter("event_type = 'purchase'").select("event_id", "user_id", "us")
    return out(joins.as_of(rows, clicks, ["user_id"], "us", "last_click"), "event_id", "user_id", "last_click")


_TICKS = "(epoch_us(ts) - 1704067200000000) // 60000000"


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, {_TICKS} AS tick FROM events),
c AS (SELECT user_id, 0 AS tick, 500000 AS micros, -1 AS seq FROM e GROUP BY 1 UNION ALL SELECT user_id, tick, 300000 + event_id % 7 * 50000, event_id FROM e WHERE event_type = 'signup'),
d AS (SELECT *, coalesce((tick - lag(tick) OVER w) * lag(micros) OVER w, 0) AS step FROM c WINDOW w AS (PARTITION BY user_id ORDER BY tick, seq)),
s AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY tick, seq ROWS UNBOUNDED PRECEDING) AS base, row_number() OVER (PARTITION BY user_id, tick ORDER BY seq DESC) AS k FROM d)
SELECT event_id, CAST(floor((base + (e.tick - s.tick) * micros) / 1000.0 / 480) AS BIGINT) AS ms FROM e ASOF JOIN (SELECT * FROM s WHERE k = 1) s ON e.user_id = s.user_id AND e.tick >= s.tick""")
def asof_tempo_ms(spark, sf_dir):
    """Minutes are ticks and signups are tempo changes of their user."""
    rows = events(spark, sf_dir).withColumn("tick", F.floor((F.col("us") - 1704067200000000) / 60000000))
    changes = rows.filter("event_type = 'signup'").select("user_id", "tick", (F.lit(300000) + F.col("event_id") % 7 * 50000).alias("micros"), F.col("event_id").alias("seq"))
    return out(joins.tempo_ms(rows.select("event_id", "user_id", "tick"), changes, ["user_id"]), "event_id", "ms")


@query("""WITH a AS (SELECT user_id, event_id AS on_at, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, event_id AS off_at, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'view')
SELECT user_id, on_at, off_at FROM a JOIN b USING (user_id, k)""")
def on_off_pairs(spark, sf_dir):
    every = events(spark, sf_dir)
    return out(joins.pair_oldest(every.filter("event_type = 'click'"), every.filter("event_type = 'view'"), ["user_id"], "event_id"), "user_id", "on_at", "off_at")


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(event_id, ts) AS event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def state_at_seek(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "us", "event_type", "event_id")
    return out(joins.state_at(rows, ["user_id"], "us", F.lit(1705276800000000)), "user_id", "event_type", "event_id")


@query("""WITH n AS (SELECT user_id, epoch_us(ts) / 3600000000.0 AS s, epoch_us(ts) / 3600000000.0 + value / 20 AS e, 30 + event_id % 60 AS pitch, event_id FROM events),
g AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) - e AS gap FROM n),
a AS (SELECT user_id, count(*) AS n, median(pitch) AS mp, avg(e - s) AS d, CASE WHEN count(*) > 1 THEN count(*) FILTER (gap <= 0.05) / (count(*) - 1) ELSE 0 END AS l FROM g GROUP BY 1)
SELECT user_id, n, round(mp, 6) AS median_pitch, round(l, 6) AS legato, CASE WHEN n < 4 THEN NULL WHEN mp <= 48 THEN 'BASS' WHEN l >= 0.6 THEN 'SUSTAINED_PAD' WHEN d <= 5 AND l <= 0.3 THEN 'RHYTHMIC_PLUCK' ELSE 'LEAD' END AS role FROM a""")
def note_shape_role(spark, sf_dir):
    """Hours are seconds; a note lasts a twentieth of its value."""
    start = F.col("us") / 3600000000.0
    notes = events(spark, sf_dir).select("user_id", "event_id", start.alias("s"), (start + F.col("value") / 20).alias("e"), (30 + F.col("event_id") % 60).alias("pitch"))
    shapes = stems.note_shapes(notes, ["user_id"], "s", "e", "pitch", "event_id")
    return out(stems.roles(shapes, short=5.0), "user_id", "n", "median_pitch", "legato", "role")


def scores(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("cls", "score"))


_SCORES = "WITH s AS (SELECT vec_id, label, unnest(generate_series(0, len(embedding) - 1)) AS cls, unnest(embedding) AS score FROM embeddings)"


@query(_SCORES + " SELECT vec_id, cls, round(CAST(score AS DOUBLE), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, (cls + 30) % 64 DESC) AS k FROM s WHERE cls % 3 <> 0 AND score >= CAST(0.2 AS FLOAT)) WHERE k = 1")
def score_argmax(spark, sf_dir):
    mapped = scores(spark, sf_dir).filter("cls % 3 <> 0").withColumn("ord", (F.col("cls") + 30) % 64)
    return out(stems.best_class(mapped, ["vec_id"], "cls", "score", F.lit(0.2).cast("float"), "ord"), "vec_id", "cls", "score")


@query(_SCORES + " SELECT CAST(label AS BIGINT) AS label, cls, round(avg(CAST(score AS DOUBLE)), 6) AS mean_score, round(CAST(max(score) AS DOUBLE), 6) AS max_score FROM s GROUP BY 1, 2")
def score_meanpool(spark, sf_dir):
    pooled = scores(spark, sf_dir).groupBy("label", "cls").agg(F.avg(F.col("score").cast("double")).alias("mean_score"), F.max("score").alias("max_score"))
    return out(pooled, "label", "cls", "mean_score", "max_score")


@query(_SCORES + ", a AS (SELECT cls, avg(CAST(score AS DOUBLE)) AS m FROM s GROUP BY 1) SELECT cls, round(m, 6) AS mean_score FROM a ORDER BY m DESC, cls LIMIT 15")
def score_topk(spark, sf_dir):
    top = scores(spark, sf_dir).groupBy("cls").agg(F.avg(F.col("score").cast("double")).alias("mean_score")).orderBy(F.desc("mean_score"), "cls").limit(15)
    return out(top, "cls", "mean_score")


@query(_SCORES + """, p AS (SELECT vec_id, sum(CAST(score AS DOUBLE) ** 2) AS t, sum(CASE WHEN cls * 250 < 1500 THEN CAST(score AS DOUBLE) ** 2 ELSE 0 END) AS l, sum(CASE WHEN cls * 250 >= 6000 THEN CAST(score AS DOUBLE) ** 2 ELSE 0 END) AS h FROM s GROUP BY 1)
SELECT vec_id, round(CASE WHEN t > 0 THEN l / t ELSE 0 END, 6) AS low, round(CASE WHEN t > 0 THEN h / t ELSE 0 END, 6) AS high FROM p""")
def band_power(spark, sf_dir):
    """The place in the vector is a bin of 250 Hz."""
    power, hz = F.col("score").cast("double") * F.col("score").cast("double"), F.col("cls") * 250
    total = F.sum(power)
    share = lambda inside: F.when(total > 0, F.sum(F.when(inside, power).otherwise(0.0)) / total).otherwise(0.0)
    return out(scores(spark, sf_dir).groupBy("vec_id").agg(share(hz < 1500).alias("low"), share(hz >= 6000).alias("high")), "vec_id", "low", "high")


@query("WITH r AS (SELECT CAST(k AS BIGINT) AS region, k * 3 AS lo, k * 3 + 7 AS hi FROM generate_series(0, 15) t(k)) SELECT p_partkey, region FROM part JOIN r ON p_size BETWEEN lo AND hi")
def region_match(spark, sf_dir):
    regions = spark.range(16).select(F.col("id").alias("region"), (F.col("id") * 3).alias("lo"), (F.col("id") * 3 + 7).alias("hi"))
    return out(joins.in_regions(table(spark, sf_dir, "part"), regions, "p_size", "lo", "hi", 8), "p_partkey", "region")


@query("""WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), o AS (SELECT user_id, n, unnest(generate_series(0, n - 1, 7)) AS "offset" FROM t), v AS (SELECT *, least(10, n - "offset") AS valid FROM o), s AS (SELECT *, (10 - valid) // 2 AS lead FROM v)
SELECT user_id, "offset", valid, greatest(0, "offset" - lead) AS read_start, least(n, "offset" - lead + 10) - greatest(0, "offset" - lead) AS read_length, greatest(0, lead - "offset") AS pad_left, lead AS trim_start FROM s""")
def chunk_placement(spark, sf_dir):
    tracks = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return out(overlap.placements(tracks, ["user_id"], "n", 10), "user_id", "offset", "valid", "read_start", "read_length", "pad_left", "trim_start")


@query("""WITH x AS (SELECT event_type, value, event_id % 10 AS i, epoch_us(ts) // 3600000000 AS frame FROM events), w AS (SELECT *, (CASE WHEN i < 5 THEN i + 1 ELSE 10 - i END) / 5.0 AS wt FROM x)
SELECT event_type, frame, round(sum(wt * value) / greatest(sum(wt), 1e-8), 6) AS value FROM w GROUP BY 1, 2""")
def overlap_add(spark, sf_dir):
    """What several chunks say of an hour: an event's place in its chunk is told by its id."""
    rows = events(spark, sf_dir).withColumn("frame", F.floor(F.col("us") / HOUR).cast("long")).withColumn("i", F.col("event_id") % 10)
    return out(overlap.overlap_add(rows, KEY, "frame", "i", "value", 10), "event_type", "frame", "value")


_INDEX = _ENERGY + ", s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY frame) - 1 AS i, energy FROM e)"


def indexed(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("frame")
    return hours(spark, sf_dir).withColumn("i", (F.row_number().over(w) - 1).cast("long"))


@query(_INDEX + """, n AS (SELECT event_type, count(*) AS n FROM s GROUP BY 1), o AS (SELECT event_type, n, unnest(generate_series(0, CAST(floor(n * 22050 / 44100) AS BIGINT) - 1)) AS out FROM n)
SELECT o.event_type, out, round(a.energy + (coalesce(b.energy, a.energy) - a.energy) * (out * 44100 / 22050.0 - floor(out * 44100 / 22050.0)), 6) AS energy FROM o JOIN s a ON a.event_type = o.event_type AND a.i = floor(out * 44100 / 22050.0) LEFT JOIN s b ON b.event_type = o.event_type AND b.i = a.i + 1""")
def resample_half(spark, sf_dir):
    return out(series.resample(indexed(spark, sf_dir), KEY, "i", "energy", 44100, 22050), "event_type", "out", "energy")


@query(_INDEX + """, n AS (SELECT event_type, count(*) AS n FROM s GROUP BY 1), o AS (SELECT event_type, n, unnest(generate_series(0, n * 8 // 5 - 1)) AS out FROM n)
SELECT o.event_type, out, round(a.energy + (coalesce(b.energy, a.energy) - a.energy) * (out * 5 / 8 - a.i), 6) AS energy FROM o JOIN s a ON a.event_type = o.event_type AND a.i = out * 5 // 8 LEFT JOIN s b ON b.event_type = o.event_type AND b.i = a.i + 1""")
def resample_linear(spark, sf_dir):
    return out(series.resample(indexed(spark, sf_dir), KEY, "i", "energy", 5, 8), "event_type", "out", "energy")


@query("SELECT epoch_us(ts) // 3600000000 AS frame, c AS channel, round(avg(value), 6) AS value FROM events, (VALUES ('left'), ('right')) t(c) GROUP BY 1, 2")
def remix_mean(spark, sf_dir):
    """Five channels averaged to two equal ones."""
    mixed = events(spark, sf_dir).groupBy(F.floor(F.col("us") / HOUR).alias("frame")).agg(F.avg("value").alias("value"))
    return out(mixed.withColumn("channel", F.explode(F.array(F.lit("left"), F.lit("right")))), "frame", "channel", "value")


@query(_INDEX.replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT event_type, i, 0.25 * energy AS y FROM s WHERE i = 0 UNION ALL SELECT s.event_type, s.i, r.y + 0.25 * (s.energy - r.y) FROM r JOIN s ON s.event_type = r.event_type AND s.i = r.i + 1)
SELECT event_type, i, round(y, 6) AS smooth FROM r""")
def onepole(spark, sf_dir):
    return out(series.one_pole(indexed(spark, sf_dir), KEY, "i", "energy", 0.25), "event_type", "i", "smooth")


@query(_ENERGY + """, l AS (SELECT event_type, frame AS x FROM e WHERE energy >= 60), n AS (SELECT *, CASE WHEN x - lag(x) OVER w > 11 OR lag(x) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM l WINDOW w AS (PARTITION BY event_type ORDER BY x)),
g AS (SELECT *, sum(f) OVER (PARTITION BY event_type ORDER BY x) AS run FROM n)
SELECT event_type, min(x) AS "begin", max(x) AS "end", count(*) AS n FROM g GROUP BY event_type, run""")
def gap_runs(spark, sf_dir):
    return out(series.gap_runs(hours(spark, sf_dir), KEY, "frame", "energy < 60", 10), "event_type", "begin", "end", "n")


@query("""WITH o AS (SELECT user_id, epoch_us(ts) AS us FROM events), n AS (SELECT *, CASE WHEN us - lag(us) OVER w > 21600000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM o WINDOW w AS (PARTITION BY user_id ORDER BY us)),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us) AS run FROM n) SELECT user_id, min(us) AS "begin", count(*) AS n FROM g GROUP BY user_id, run""")
def session_notes(spark, sf_dir):
    """Session windows that six hours of silence close."""
    grouped = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return out(grouped.withColumn("begin", F.unix_micros(F.col("w.start").cast("timestamp"))), "user_id", "begin", "n")


@query("WITH k AS (SELECT s_suppkey, s_nationkey, s_suppkey % 11 = 0 AS drum, (row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 11 = 0 ORDER BY s_suppkey) - 1) % 15 AS i FROM supplier) SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, CASE WHEN drum THEN 9 WHEN i >= 9 THEN i + 1 ELSE i END AS channel FROM k")
def channel_assign(spark, sf_dir):
    return out(stems.channels(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey", F.col("s_suppkey") % 11 == 0), "s_suppkey", "s_nationkey", "channel")


@query("SELECT o_orderkey, o_custkey, o_orderkey - lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS delta FROM orders")
def delta_encode(spark, sf_dir):
    w = series.by(["o_custkey"], "o_orderkey")
    return out(table(spark, sf_dir, "orders").withColumn("delta", F.col("o_orderkey") - F.lag("o_orderkey", 1, 0).over(w)), "o_orderkey", "o_custkey", "delta")


@query("SELECT o_custkey, o_orderkey, CAST(sum(o_orderkey % 100) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS tick FROM orders")
def delta_decode(spark, sf_dir):
    w = series.by(["o_custkey"], "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return out(table(spark, sf_dir, "orders").withColumn("tick", F.sum(F.col("o_orderkey") % 100).over(w)), "o_custkey", "o_orderkey", "tick")


@query("""WITH v AS (SELECT o_orderkey, o_orderkey * 37 % 268435456 AS v FROM orders)
SELECT o_orderkey, lower((CASE WHEN v >= 2097152 THEN printf('%02x', (v >> 21) & 127 | 128) ELSE '' END) || (CASE WHEN v >= 16384 THEN printf('%02x', (v >> 14) & 127 | 128) ELSE '' END) || (CASE WHEN v >= 128 THEN printf('%02x', (v >> 7) & 127 | 128) ELSE '' END) || printf('%02x', v & 127)) AS vlq FROM v""")
def vlq_hex(spark, sf_dir):
    return out(table(spark, sf_dir, "orders").withColumn("vlq", N.vlq_hex(F.col("o_orderkey") * 37 % 268435456)), "o_orderkey", "vlq")


@query("WITH k AS (SELECT event_id, user_id, epoch_us(ts) // 86400000000 AS tick, CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS o FROM events) SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY tick, o, event_id) AS place FROM k")
def event_order(spark, sf_dir):
    """Program changes before ends before starts within a tick, then in the order given."""
    rank = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    w = Window.partitionBy("user_id").orderBy(F.floor(F.col("us") / 86400000000), rank, "event_id")
    return out(events(spark, sf_dir).withColumn("place", F.row_number().over(w)), "event_id", "user_id", "place")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(i * 256 / 22050.0 - (i // 172) * (256 / 22050.0 * (172 - 43844 / 256.0) + 0.0018), 6) AS sec FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS i FROM lineitem)")
def frame_time(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("i", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return out(rows.select("l_orderkey", "l_linenumber", N.frame_seconds(F.col("i")).alias("sec")), "l_orderkey", "l_linenumber", "sec")


@query("""SELECT event_id, list_transform([event_id % 65536 - 32768, 0, 32767], lambda x: round(x / 32768.0, 6)) AS scaled,
list_transform([value / 10, -4.5, 4.0], lambda x: CASE WHEN abs(x) > 4 THEN 0 ELSE round(x, 6) END) AS tamed FROM events""")
def sample_ranges(spark, sf_dir):
    """Sixteen-bit numbers as samples, and samples beyond 4 as silence."""
    shorts = F.array((F.col("event_id") % 65536 - 32768).cast("int"), F.lit(0), F.lit(32767))
    rows = pcm.scaled(table(spark, sf_dir, "events").withColumn("shorts", shorts)).withColumn("x", F.array((F.col("value") / 10).cast("float"), F.lit(-4.5).cast("float"), F.lit(4.0).cast("float")))
    places = lambda c: F.transform(c, lambda x: F.round(x.cast("double"), 6))
    return rows.select("event_id", places("samples").alias("scaled"), places(pcm.tamed("x")).alias("tamed"))


@query("SELECT user_id, event_id, event_id % 131 AS program, CASE WHEN event_id % 131 < 128 THEN 1 ELSE 0 END AS known FROM events")
def program_names(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("program", F.col("event_id") % 131)
    named = stems.named(rows)
    return out(named.withColumn("known", (F.col("program_name") != "Unknown").cast("long")), "user_id", "event_id", "program", "known")


@query("SELECT event_id, CAST(floor(value * 480 * (60 + event_id % 141) / 60 + 0.5) AS BIGINT) AS ticks, 60000000 // (60 + event_id % 141) AS micros FROM events")
def ticks(spark, sf_dir):
    bpm = 60 + F.col("event_id") % 141
    return out(events(spark, sf_dir).select("event_id", N.ticks(F.col("value"), bpm).alias("ticks"), N.micros_per_quarter(bpm).alias("micros")), "event_id", "ticks", "micros")


@query("SELECT source, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2, 3")
def label_confusion(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return out(joined.groupBy("source", "quality", "toxic").agg(F.count("*").alias("n")), "source", "quality", "toxic", "n")


@query("""WITH h AS (SELECT event_type, epoch_us(ts) // 3600000000 - 473352 AS frame, value FROM events), c AS (SELECT *, unnest(generate_series(0, 720, 7)) AS o FROM h),
w AS (SELECT event_type, frame, value * (1 + o % 3) AS v, CASE WHEN frame - o < 5 THEN frame - o + 1 ELSE 10 - (frame - o) END / 5.0 AS wt FROM c WHERE frame - o BETWEEN 0 AND 9)
SELECT event_type, frame, round(sum(wt * v) / greatest(sum(wt), 1e-8), 6) AS value FROM w GROUP BY 1, 2""")
def overlap_add_chunks(spark, sf_dir):
    """Chunks of ten hours, one every seven, that each tell their hours differently: up to two of them say something of an hour."""
    hour = F.floor(F.col("us") / HOUR).cast("long") - 473352
    said = events(spark, sf_dir).select("event_type", hour.alias("frame"), "value")
    first = F.greatest(F.lit(0), F.ceil((F.col("frame") - 9) / 7))
    dealt = said.withColumn("o", F.explode(F.sequence(first.cast("long") * 7, F.floor(F.col("frame") / 7).cast("long") * 7, F.lit(7).cast("long"))))
    rows = dealt.select("event_type", "frame", (F.col("frame") - F.col("o")).alias("i"), (F.col("value") * (1 + F.col("o") % 3)).alias("value"))
    return out(overlap.overlap_add(rows, KEY, "frame", "i", "value", 10), "event_type", "frame", "value")


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, value FROM events), n AS (SELECT event_id, user_id, us AS b, us + 3600000000 * (1 + event_id % 40) AS f FROM e WHERE event_type = 'purchase'), t AS (SELECT user_id, max(abs(value)) AS top FROM e GROUP BY 1)
SELECT n.event_id, round(max(abs(e.value)), 6) AS peak, CAST(greatest(40, least(127, floor(127 * max(abs(e.value)) / greatest(any_value(top), 1e-6) + 0.5))) AS BIGINT) AS velocity FROM n JOIN e ON e.user_id = n.user_id AND e.us >= b AND e.us < f JOIN t ON t.user_id = n.user_id GROUP BY 1""")
def span_peak_velocity(spark, sf_dir):
    """Purchases are notes of 1 to 40 hours, and all events of their user are samples: loudness of the note's own span against the user's."""
    every = events(spark, sf_dir)
    notes = every.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("us").alias("b"), (F.col("us") + HOUR * (1 + F.col("event_id") % 40)).alias("f"))
    top = every.groupBy("user_id").agg(F.max(F.abs("value")).alias("top"))
    heard = joins.peak_between(notes, every, ["user_id"], "b", "f", "us", "value", 4 * HOUR).join(top, "user_id")
    loud = N.half_up(127 * F.col("peak") / F.greatest(F.col("top"), F.lit(1e-6)))
    return out(heard.withColumn("velocity", N.clip(loud, 40, 127)), "event_id", "peak", "velocity")


def signal_of_users(spark, sf_dir):
    """The values of each user in order of time as mono samples, in chunks of 16."""
    w = Window.partitionBy("user_id").orderBy("us")
    rows = events(spark, sf_dir).select("user_id", (F.row_number().over(w) - 1).cast("long").alias("k"), F.col("value").cast("float").alias("x"))
    chunks = rows.groupBy("user_id", F.floor(F.col("k") / 16).alias("chunk_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]).alias("samples"))
    return chunks.withColumn("start", F.col("chunk_no") * 16)


_SAMPLES = "WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k, CAST(value AS FLOAT) AS x FROM events), n AS (SELECT user_id, count(*) AS n FROM x GROUP BY 1)"


@query(_SAMPLES + """, w AS (SELECT user_id, n, unnest(generate_series(0, (n + 5) // 14)) AS window_no FROM n), s AS (SELECT user_id, n, window_no, unnest(generate_series(0, 19)) AS i FROM w WHERE window_no * 14 < n + 6)
SELECT s.user_id, window_no, i, round(CAST(coalesce(x.x, 0) AS DOUBLE), 6) AS x FROM s LEFT JOIN x ON x.user_id = s.user_id AND x.k = window_no * 14 + i - 6""")
def model_windows(spark, sf_dir):
    """Windows of 20 samples every 14, counted from six zeros before the first."""
    rows = windows.fixed(signal_of_users(spark, sf_dir), ["user_id"], 20, 14, 6)
    return out(rows.select("user_id", "window_no", F.posexplode("samples").alias("i", "x")), "user_id", "window_no", "i", "x")


@query(_SAMPLES + """, f AS (SELECT user_id, n, unnest(generate_series(0, (n + 5) // 14)) AS w FROM n), s AS (SELECT user_id, n, w, unnest(generate_series(0, 9)) AS i FROM f WHERE w * 14 < n + 6)
SELECT user_id, w * 6 + i - 2 AS t, w * 100 + i AS v FROM s WHERE i BETWEEN 2 AND 7 AND w * 6 + i - 2 < n * 3 // 7""")
def window_frames(spark, sf_dir):
    """A model that says window * 100 + frame for ten frames a window: two go at both ends, the rest is numbered on and cut to the signal."""
    audio = signal_of_users(spark, sf_dir)
    said = windows.fixed(audio, ["user_id"], 20, 14, 6).select("user_id", "window_no", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("f"))
    totals = audio.groupBy("user_id").agg(F.floor(F.sum(F.size("samples")) * 3 / 7).alias("total"))
    rows = said.withColumn("v", F.col("window_no") * 100 + F.col("f"))
    return out(windows.trimmed(rows, ["user_id"], totals, frames=10, edge=2), "user_id", "t", "v")


@query(_SAMPLES + """, c AS (SELECT user_id, n // 2 AS n FROM n), o AS (SELECT user_id, n, unnest(generate_series(0, n - 1, 7)) AS "offset" FROM c), v AS (SELECT *, (10 - least(10, n - "offset")) // 2 AS lead FROM o),
s AS (SELECT *, unnest(generate_series(0, 19)) AS i FROM v), q AS (SELECT *, "offset" - lead + i % 10 AS frame, i // 10 AS c FROM s)
SELECT q.user_id, "offset", i, round(CAST(coalesce(CASE WHEN frame BETWEEN 0 AND n - 1 THEN x.x END, 0) AS DOUBLE), 6) AS x FROM q LEFT JOIN x ON x.user_id = q.user_id AND x.k = frame * 2 + c""")
def model_slices(spark, sf_dir):
    """The same samples as two channels: planar inputs of ten frames at the places of overlapping chunks."""
    audio = signal_of_users(spark, sf_dir).withColumn("start", F.col("chunk_no") * 8)
    totals = audio.groupBy("user_id").agg(F.floor(F.sum(F.size("samples")) / 2).alias("n"))
    rows = windows.planar(audio, overlap.placements(totals, ["user_id"], "n", 10), ["user_id"], 10, 8)
    return out(rows.select("user_id", "offset", F.posexplode("samples").alias("i", "x")), "user_id", "offset", "i", "x")


@query("WITH r AS (SELECT CAST(k AS BIGINT) AS region, k * 3 AS lo, k * 3 + 7 AS hi, 900 + k * 20 AS lov, 1400 - k * 10 AS hiv FROM generate_series(0, 15) t(k)) SELECT p_partkey, region FROM part JOIN r ON p_size BETWEEN lo AND hi AND p_retailprice BETWEEN lov AND hiv")
def region_match_both(spark, sf_dir):
    """Sizes are keys and prices are velocities: both lie in the region's ranges."""
    k = F.col("id")
    regions = spark.range(16).select(k.alias("region"), (k * 3).alias("lo"), (k * 3 + 7).alias("hi"), (900 + k * 20).alias("lov"), (1400 - k * 10).alias("hiv"))
    return out(joins.in_regions(table(spark, sf_dir, "part"), regions, "p_size", "lo", "hi", 8, ("p_retailprice", "lov", "hiv")), "p_partkey", "region")


@query("""WITH k AS (SELECT user_id, event_type, event_id % 128 AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_type AS label, arg_max(p, i) AS override FROM k WHERE i <= n // 2 GROUP BY 1, 2""")
def override_pairs(spark, sf_dir):
    """Labels are a user's event types in order, programs only half as many numbers."""
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_type", (F.col("event_id") % 128).alias("p"))))
    per = events(spark, sf_dir).groupBy("user_id").agg(rows.alias("r"))
    lists = per.select("user_id", F.col("r.event_type").alias("labels"), F.slice("r.p", F.lit(1), F.floor(F.size("r") / 2).cast("int")).alias("programs"))
    return out(stems.zipped(lists, ["user_id"], "labels", "programs"), "user_id", "label", "override")


@query("""WITH l AS (SELECT user_id, list_distinct(list(event_type)) AS l FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_sort(CASE WHEN list_contains(l, 'mute') THEN l ELSE list_append(l, 'mute') END), ',') AS added, array_to_string(list_sort(list_filter(l, lambda x: x <> 'error')), ',') AS removed FROM l""")
def label_sets(spark, sf_dir):
    sets = events(spark, sf_dir).groupBy("user_id").agg(F.collect_set("event_type").alias("l"))
    named = lambda c: F.array_join(F.array_sort(c), ",")
    return out(sets.select("user_id", named(stems.with_label(F.col("l"), F.lit("mute"))).alias("added"), named(stems.without_label(F.col("l"), F.lit("error"))).alias("removed")), "user_id", "added", "removed")


@query("""WITH e AS (SELECT event_id, user_id, event_id % 5 AS note, ts, CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS "on" FROM events WHERE event_type IN ('click', 'view')),
d AS (SELECT *, "on" - coalesce(lag("on") OVER (PARTITION BY user_id, note ORDER BY ts), 0) AS step FROM e)
SELECT event_id, CAST(sum(step) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sounding FROM d""")
def sounding_notes(spark, sf_dir):
    """Clicks start and views end one of five notes of their user."""
    rows = events(spark, sf_dir).filter("event_type IN ('click', 'view')").withColumn("note", F.col("event_id") % 5)
    return out(joins.sounding(rows, ["user_id"], "note", ["us"], F.col("event_type") == "click"), "event_id", "sounding")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), x AS (SELECT user_id, list(event_type ORDER BY event_type) AS l, string_agg(event_type || '=' || CAST(n * 2 AS VARCHAR), ',' ORDER BY event_type) FILTER (n > 1 AND event_type <> 'error') AS doubled FROM c GROUP BY 1)
SELECT user_id, coalesce(doubled, '') AS doubled, array_to_string(list_reverse(l[1:2]), '<') AS first, sha256(array_to_string(l, '|')) AS digest, coalesce(l[4], '-') AS fourth FROM x""")
def collections(spark, sf_dir):
    """Map, array and hash functions over the counts of a user's event types."""
    counts = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    per = counts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("r"))
    doubled = F.transform_values(F.map_filter(F.map_from_entries("r"), lambda k, v: (v > 1) & (k != "error")), lambda k, v: v * 2)
    names = F.col("r.event_type")
    pairs = F.transform(F.map_entries(doubled), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out(per.select("user_id", F.array_join(F.array_sort(pairs), ",").alias("doubled"), F.array_join(F.reverse(F.slice(names, 1, 2)), "<").alias("first"), F.sha2(F.array_join(names, "|"), 256).alias("digest"), F.coalesce(F.get(names, F.lit(3)), F.lit("-")).alias("fourth")), "user_id", "doubled", "first", "digest", "fourth")


_FRAMES = "WITH e AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS f, round(value * 4) / 4 AS x FROM events)"


def frames_of_type(spark, sf_dir, chunk):
    """Events of each type as two channels, value and half of it, in quarters, in chunks of `chunk` frames."""
    x = F.round(F.col("value") * 4) / 4
    rows = table(spark, sf_dir, "events").select("event_type", (F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1).cast("long").alias("f"), x.alias("x"))
    own = rows.groupBy("event_type", F.floor(F.col("f") / chunk).cast("long").alias("chunk_no")).agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("r"))
    both = F.flatten(F.transform("r", lambda r: F.array(r["x"].cast("float"), (r["x"] / 2).cast("float"))))
    return own.select("event_type", "chunk_no", (F.col("chunk_no") * chunk).alias("start"), F.lit(100).alias("sample_rate"), F.lit(2).alias("channels"), both.alias("samples"))


@query(_FRAMES + """, n AS (SELECT event_type, count(*) AS total FROM e GROUP BY 1
), p AS (
  SELECT event_type, total, o, least(512, total - o) AS valid FROM (SELECT *, unnest(range(0, total, 384)) AS o FROM n)
), m AS (
  SELECT e.event_type, f, x, (512 - valid) // 2 + f - o AS place FROM e JOIN p ON e.event_type = p.event_type AND f BETWEEN o AND o + valid - 1
), w AS (
  SELECT *, CASE WHEN place < 256 THEN place + 1 ELSE 512 - place END / 256.0 AS w FROM m
)
SELECT event_type, stem, f AS frame, round(CAST(CAST(sum(w * (x * g + place / 64.0)) / sum(w) AS FLOAT) AS DOUBLE), 6) AS first, round(CAST(CAST(sum(w * (x / 2 * g + place / 64.0)) / sum(w) AS FLOAT) AS DOUBLE), 6) AS second
FROM w, (VALUES ('drums', 1.0), ('bass', 2.0)) s(stem, g) GROUP BY 1, 2, 3""")
def separated_stems(spark, sf_dir):
    """A model that doubles its input for the second stem, and adds a ramp over each slice to both."""
    def model(x):
        ramp = np.arange(x.shape[1]) / 64
        return np.stack([x + ramp, 2 * x + ramp])

    own = separation.separated(frames_of_type(spark, sf_dir, 300), separation.each_slice(model, KEY), KEY, ("drums", "bass"), 512, chunk=200, sample_rate=100)
    rows = own.select("event_type", "stem", "start", F.posexplode(F.arrays_zip(F.filter("samples", lambda _, i: i % 2 == 0).alias("a"), F.filter("samples", lambda _, i: i % 2 == 1).alias("b"))).alias("k", "s"))
    return out(rows.select("event_type", "stem", (F.col("start") + F.col("k")).alias("frame"), F.col("s.a").alias("first"), F.col("s.b").alias("second")), "event_type", "stem", "frame", "first", "second")


_TAG_CLASSES = [(c % 64, p) for c, p in stems.CLASS_PROGRAMS if 134 <= c < 198]


@query(_SCORES + ", q AS (SELECT label, cls, CAST(round(100 * avg(CAST(score AS DOUBLE)), 1) AS FLOAT) AS m FROM s GROUP BY 1, 2), c(cls, ord) AS (VALUES " + ", ".join(f"({c}, {k})" for k, (c, _) in enumerate(_TAG_CLASSES)) + """)
SELECT CAST(label AS BIGINT) AS label, CAST(cls AS BIGINT) AS class, round(CAST(m AS DOUBLE), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m DESC, ord DESC) AS k FROM q JOIN c USING (cls) WHERE m >= CAST(0.5 AS FLOAT)) WHERE k = 1""")
def pooled_tags(spark, sf_dir):
    """Vectors of a label are its patches; means in tenths, so that equal ones occur."""
    means = tagging.pooled(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    means = means.withColumn("means", F.transform("means", lambda x: F.round(100 * x, 1)))
    return out(tagging.best_tag(means, ["label"], 0.5, _TAG_CLASSES), "label", "class", "score")

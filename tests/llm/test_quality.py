import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ostinato.llm import quality, queries
from ostinato.llm.common import Rolling, as_bytes

SF = "/root/testdata/sf0.1"


def column(texts):
    import pyarrow as pa

    return as_bytes(pa.array(texts, pa.string()))


def test_statistics_equal_plain_counts():
    texts = ["The cat sat. THE cat sat!\nthe cat sat\n\nthe cat sat", "", "é ü 12 ### x%y", " \n ", "a a a b b c"] + [" ".join(random.Random(k).choice(["ab", "Cd!", "EF", "7"]) for _ in range(k)) for k in range(1, 30)]
    x = quality.statistics(*column(texts), Rolling())
    at = {n: k for k, n in enumerate(quality.NAMES)}
    for t, row in zip(texts, x):
        words = [w for w in t.replace("\n", " ").split(" ") if w]
        lines = [w for w in t.split("\n") if w]
        count = lambda xs: {w: xs.count(w) for w in xs}
        share = lambda a, b: (a / b) ** 0.5 if b else 0
        three = list(zip(words, words[1:], words[2:]))
        want = {
            "chars": np.log1p(len(t)), "words": np.log1p(len(words)), "lines": np.log1p(len(lines)), "upper": share(sum("A" <= c <= "Z" for c in t), len(t)), "digit": share(sum(c.isdigit() for c in t), len(t)),
            "sign": share(sum(c in "#%" for c in t), len(t)), "distinct": share(len(set(words)), len(words)), "top_word": share(max(count(words).values(), default=0), len(words)), "twins": share(sum(a == b for a, b in zip(words, words[1:])), len(words)),
            "again3": share(sum(c for c in count(three).values() if c > 1), len(words)), "again_lines": share(len(lines) - len(set(lines)), len(lines)), "titled": share(sum("A" <= w[0] <= "Z" for w in words), len(words)), "ended_lines": share(sum(u[-1] in ".!?" for u in lines), len(lines)),
            "word_entropy": -sum(c / len(words) * np.log(c / len(words)) for c in count(words).values()), "numbers": share(sum(w.isdigit() for w in words), len(words)),
        }
        for name, v in want.items():
            assert abs(row[at[name]] - v) < 1e-4, (t, name, row[at[name]], v)
    assert not x[1].any()


def test_random_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, len(quality.NAMES)))
    turns, shift = quality.projections(1.0, 20_000)
    model = quality.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), turns, shift, None, None, None)
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * len(quality.NAMES)))
    assert np.abs(z @ z.T - kernel).max() < 0.06


def test_isotonic_equals_the_least_squares_fit():
    """The max-min formula, for every position."""
    r = np.random.default_rng(2)
    for n in (1, 2, 9, 40):
        v, w = r.random(n), r.integers(1, 9, n).astype(float)
        mean = lambda a, b: (v[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
        assert np.allclose(quality.isotonic(v, w), want)


def test_partition_sums_equal_one_regression(spark):
    docs = queries.read(spark, "/root/testdata/sf0.01", "documents")
    stats = quality.described(docs).cache()
    labels = queries.read(spark, "/root/testdata/sf0.01", "labels")
    model = quality.learn(stats, labels)
    y = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    rows = [(r.x, y[r.id]) for r in stats.collect() if r.id in y]
    z = model.features(np.array([x for x, _ in rows], float))
    for penalty in quality.RIDGES:
        loss = np.append(np.full(z.shape[1] - 1, penalty * len(rows)), 1e-9)
        w = np.linalg.solve(z.T @ z + np.diag(loss), z.T @ np.array([v for _, v in rows]))
        if np.allclose(w, model.weights, atol=1e-4):
            break
    else:
        raise AssertionError("no ridge gives these weights")
    again = quality.learn(stats.repartition(7), labels.repartition(3))
    assert np.allclose(again.weights, model.weights, atol=1e-6) and (np.diff(model.chance) >= 0).all()


def test_quality_on_held_out_rows(spark):
    labels = queries.read(spark, SF, "labels")
    got = queries.op13_quality(spark, SF)
    assert got.count() == queries.read(spark, SF, "documents").count()
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.99 * len(rows)
    assert sum(r.predicted for r in rows if r.quality == 1) >= 0.995 * sum(r.quality for r in rows)
    # calibrated: scores mean what they say
    assert abs(sum(r.score for r in rows) - sum(r.quality for r in rows)) < 0.02 * len(rows)


def test_odd_and_empty_tables(spark, odd, none):
    docs = queries.read(spark, "/root/testdata/sf0.001", "documents")
    labels = queries.read(spark, "/root/testdata/sf0.001", "labels")
    stats = quality.described(docs)
    model = quality.learn(stats, labels)
    x = quality.described(odd, "doc_id")
    got = quality.predict(x, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in got if r.doc_id == 1}
    assert len(same) == 1
    assert quality.score(none, labels).count() == 0
    assert {r.score for r in quality.score(odd, labels.filter("1 = 0")).collect()} == {0.5}
    assert {r.score for r in quality.predict(stats, quality.learn(stats, labels.withColumn("quality", F.lit(1)))).collect()} == {1.0}
    mixed = labels.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, F.col("quality"))).unionByName(labels)
    assert np.isfinite(quality.learn(stats, mixed).weights).all()

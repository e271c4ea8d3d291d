import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ostinato.llm import langid, queries, toxicity
from ostinato.llm.common import Rolling, word_bounds

SF = "/root/testdata/sf0.01"


def test_word_bounds_stop_at_rows():
    text = np.frombuffer(b"ab cd" + b"ef" + b"" + b" gh ", np.uint8)
    start, end, row = word_bounds(text, np.array([0, 5, 7, 7, 11]))
    assert list(zip(start.tolist(), end.tolist(), row.tolist())) == [(0, 2, 0), (3, 5, 0), (5, 7, 1), (8, 10, 3)]


def test_rolling_hashes_depend_on_bytes_only():
    raw = np.frombuffer(b"abcabcab", np.uint8)
    r = Rolling()
    h = r.of(r.load(raw), np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert h[0] == h[1] != h[2]


def toxic_docs(spark, n=600):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        text = [r.choice(words) for _ in range(60)]
        if bad:
            for _ in range(3):
                text[r.randrange(60)] = r.choice(["Vileword", "scumlike", "horrid" + r.choice(words)])
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_docs(spark)
    got = toxicity.report(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)
    model = toxicity.learn(docs, labels)
    assert 0 < len(model.keys) < 200  # sparse
    again = toxicity.learn(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(model.keys, again.keys) and np.allclose(model.weights, again.weights)


def test_toxicity_on_odd_rows(spark, odd, none):
    docs, labels = toxic_docs(spark, 100)
    model = toxicity.learn(docs, labels)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.clean(odd, labels.filter("1 = 0")).columns == odd.columns
    assert toxicity.clean(odd, labels.filter("1 = 0")).count() == odd.count()
    one = labels.withColumn("toxic", F.lit(0))
    assert toxicity.learn(docs, one).bias == -np.inf


def test_languages_on_held_out_rows(spark):
    docs = queries.read(spark, SF, "documents")
    got = queries.op8_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in got)


def test_languages_on_odd_rows(spark, odd, none):
    docs = queries.read(spark, "/root/testdata/sf0.001", "documents")
    model = langid.learn(docs)
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count() and sum(r.lang_pred == "und" for r in got) == 3
    assert langid.learn(none) is None and {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0
    few = langid.learn(docs.filter("lang = 'fr'"))
    assert few.languages == ["fr"]


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 30):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code}) == n and (np.abs(code.sum(0)) < n).all()


def test_ftrl_equals_the_plain_rule():
    """FTRL-proximal one coordinate at a time, from its formulas."""
    import math

    r = random.Random(3)
    rows = [(np.unique(np.array([r.randrange(40) for _ in range(8)] + ([99] if y else []), np.uint32)), y) for y in (r.random() < 0.3 for _ in range(200))]
    rows = [(x, int(y)) for x, y in rows]
    got = toxicity.ftrl(rows, 0.7, 1.0, 2.0, 0.1, 3, 3)
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= (0.0 if k == "bias" else 2.0):
            return 0.0
        return -math.copysign(abs(z[k]) - (0.0 if k == "bias" else 2.0), z[k]) / ((1.0 + math.sqrt(n[k])) / 0.7 + 0.1)

    often = {k for k in range(100) if sum(k in x for x, _ in rows) >= 3}
    for _ in range(3):
        for x, y in rows:
            own = [int(k) for k in x if int(k) in often] + ["bias"]
            w = {k: weight(k) for k in own}
            p = 1 / (1 + math.exp(-sum(w.values())))
            for k in own:
                g, old = p - y, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / 0.7 * w[k]
                n[k] = old + g * g
    want = {k: weight(k) for k in z if k != "bias" and weight(k)}
    assert dict(zip(got.keys.tolist(), got.weights.round(9).tolist())) == {k: round(v, 9) for k, v in want.items()}
    assert abs(got.bias - weight("bias")) < 1e-9 and 99 in want and len(want) < 40


def test_scores_mean_the_same_when_one_label_is_sampled(spark):
    """With a fortieth of the common label left out of learning, the mean score stays near the share of label 1."""
    docs, labels = toxic_docs(spark, 1600)
    few = toxicity.learn(docs, labels, sample_rows=100)
    all_ = toxicity.learn(docs, labels)
    assert few.bias != all_.bias and 0 < len(few.keys)
    mean = toxicity.score(docs, few).agg(F.avg("score")).first()[0]
    assert 0.1 < mean < 0.4
    bounded = toxicity.learn(docs, labels, sample_bytes=20_000)
    assert len(bounded.keys) > 0


def test_repeated_ids_keep_to_the_sample(spark):
    docs, labels = toxic_docs(spark, 100)
    many = docs.unionByName(spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("same id "), F.col("id").cast("string")).alias("text")))
    seen = []
    plain = toxicity.ftrl
    try:
        toxicity.ftrl = lambda rows: seen.append(len(rows)) or plain(rows)
        toxicity.learn(many, labels, sample_rows=50)
    finally:
        toxicity.ftrl = plain
    assert seen[0] <= 100
    named = many.withColumn("lang", F.lit("en")).withColumn("doc_id", F.lit(None).cast("long"))
    assert langid.learn(named, sample_rows=20).languages == ["en"]


def test_decoding_equals_the_plain_rule():
    """Loss-weighted distances to all codewords, one by one, and the lead of the best."""
    import math

    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(120, langid.DIMENSIONS))).astype(np.float32) * 0.01
    y = rng.integers(0, 3, 120)
    for k in range(3):
        x[y == k, 10 * k : 10 * k + 5] += 0.4
    model = langid.fit(x, y, ["a", "b", "c"])
    near = np.concatenate([x[:20], (x[y == 0][:5] + x[y == 1][:5]) / 2])
    which, score, lead = model.decode(near)
    for i, v in enumerate(near):
        margins = [sum(float(a) * float(b) for a, b in zip(v, model.weights[:, j])) + float(model.bias[j]) for j in range(model.code.shape[1])]
        loss = [sum(t * math.log1p(math.exp(-m * c)) for m, c, t in zip(margins, word, model.trust)) for word in model.code]
        chance, near_ = math.exp(-min(loss)) / sum(math.exp(-u) for u in loss), sorted(loss)
        assert which[i] == int(np.argmin(loss)) and abs(score[i] - chance) < 1e-4 and abs(lead[i] - (near_[1] - near_[0]) / sum(model.trust)) < 1e-4
    assert (which[:20] == y[:20]).mean() > 0.9 and score[20:].mean() < score[:20].mean()


def test_mixed_texts_are_ambiguous(spark):
    docs = queries.read(spark, SF, "documents")
    model = langid.learn(docs)
    one = {r.lang: r.text for r in docs.filter("length(text) BETWEEN 400 AND 4000").select("lang", "text").dropDuplicates(["lang"]).collect()}
    a, b = sorted(one)[:2]
    rows = []
    for share in range(0, 21):
        n = 400
        rows.append((share, one[a][: n * share // 20] + " " + one[b][: n - n * share // 20]))
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert not got[0].ambiguous and not got[20].ambiguous and got[0].lang_pred == b and got[20].lang_pred == a
    assert any(got[k].ambiguous for k in range(7, 14)) and not any(got[k].ambiguous for k in (0, 1, 2, 18, 19, 20))
    clean = langid.predict(docs.filter("length(text) > 300"), model)
    assert clean.filter("ambiguous").count() <= 0.01 * clean.count()


def test_a_column_of_many_languages_keeps_to_the_bounds(spark, monkeypatch):
    """Three thousand values, most of them dirt: the frequent ones are learned, from a bounded number of rows."""
    docs = queries.read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    dirty = spark.range(3000).select((F.col("id") + 10_000).alias("doc_id"), F.lit("some words here").alias("text"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("lang"))
    seen, plain = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda x, y, languages: seen.append(len(x)) or plain(x, y, languages))
    model = langid.learn(docs.unionByName(dirty), sample_total=60, most_languages=8)
    known = {r.lang for r in docs.filter("lang IS NOT NULL").select("lang").distinct().collect()}
    assert len(model.languages) <= 8 and known & set(model.languages) and seen[0] <= 60
    one = langid.learn(docs)
    assert set(one.languages) == known


def test_vectors_equal_plain_counts():
    """Square roots of shares of hashed n-grams of one to three letters, one by one."""
    from ostinato.llm.common import as_bytes
    import pyarrow as pa

    texts = ["Ab, é", "", "zz", "a"]
    raw, at = as_bytes(pa.array(texts))
    got = langid.vectors(raw, at)
    for t, row in zip(texts, got):
        b = [int(langid._LETTERS[c]) for c in t.encode()]
        grams = [g for g in b] + [x * 257 + y + 1 for x, y in zip(b, b[1:])] + [x * 66049 + y * 257 + z + 2 for x, y, z in zip(b, b[1:], b[2:])]
        want = np.zeros(langid.DIMENSIONS)
        for g in grams:
            want[(g * 2654435761 % 2**32) >> 20] += 1
        want = np.sqrt(want)
        assert np.allclose(row, want / max(np.linalg.norm(want), 1e-9), atol=1e-5)

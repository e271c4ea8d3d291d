import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.llm import variants

SHAPE = "doc_id long, text string, word string, n long, head string, id string"


def one_edit(a, b):
    """One inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts):
    rows = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        rows[w] = [form, n, len(near), counts[form] if form else None]
    for w, row in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        row.insert(1, root)
    return {w: tuple(r) for w, r in rows.items()}


def vocabulary(seed, n, alphabet="abé", longest=9):
    r = random.Random(seed)
    return {"".join(r.choice(alphabet) for _ in range(r.randint(1, longest))): r.randint(1, 60) for _ in range(n)}


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("most", [2, 7, 128])
def test_variants_equal_all_pairs(spark, most):
    counts = vocabulary(most, 250)
    got = result(variants.variants(table(spark, counts), most))
    assert got == plain(counts)


def test_long_and_skewed_words(spark):
    """Words that share nearly everything, of hundreds of letters: blocks are subdivided to single positions."""
    r = random.Random(4)
    base = "".join(r.choice("abcdef") for _ in range(300))
    counts = {base: 500}
    for k in range(150):
        p = r.randrange(300)
        counts[r.choice([base[:p] + base[p + 1 :], base[:p] + "z" + base[p:], base[:p] + "y" + base[p + 1 :]])] = 1 + k
    for k in range(1, 40):
        counts["q" * k] = k
    assert result(variants.variants(table(spark, counts), 16)) == plain(counts)


def test_each_pair_is_found_once(spark):
    counts = vocabulary(9, 200, "ab", 8)
    pairs = [(r.word, r.other) for r in variants.near(table(spark, counts), 5).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in counts for b in counts if one_edit(a, b)}


def test_words_follow_the_rule(spark, odd, none):
    r = random.Random(2)
    words = ["Straße", "ÉTÉ", "été", "naïve", "x×y÷z", "ĀbcdĒf", "don't", "a" * 70, "É" * 40, "hello", "World", "漢字abcde", "letters"]
    rows = [(k, " ".join(r.choice(words) for _ in range(80)), "w", 1, "h", "i") for k in range(120)] + [(None, "hello hello hello", None, None, None, None), (7, None, None, None, None, None), (7, "", None, None, None, None)]
    counts = {}
    for k, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] = counts.get(w, 0) + 1
    want = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    assert any(len(w) == 69 for w in counts)
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    assert {x.word: x.n for x in variants.words(df).collect()} == want
    assert result(variants.report(df)) == plain(want)
    assert variants.words(odd).count() > 0 and variants.report(none).count() == 0


def test_checksums_and_clashing_hashes(monkeypatch):
    raw = np.frombuffer("Hello wörld hello ".encode() * 50 + b"q" * 100, np.uint8)
    text, start, end, row = variants.runs(raw, np.array([0, 30, len(raw)]))
    first = np.array([zlib.crc32(f"{k}:".encode()) for k in row], np.uint32)
    assert variants.checksums(text, start, end, first).tolist() == [zlib.crc32(f"{k}:".encode() + text[a:b].tobytes()) for k, a, b in zip(row, start, end)]
    short = end - start <= 32
    monkeypatch.setattr(variants, "mixed", lambda words: np.zeros(len(words), np.uint64))
    at, n = variants._tally(text, start[short], end[short])
    got = {text[start[short][k] : end[short][k]].tobytes().decode(): c for k, c in zip(at, n.tolist())}
    want = {}
    for a, b in zip(start[short], end[short]):
        w = text[a:b].tobytes().decode()
        want[w] = want.get(w, 0) + 1
    assert got == want


def test_roots_of_long_ways(spark):
    ways = spark.range(37).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), F.concat(F.lit("w"), (F.col("id") + 1).cast("string")).alias("form"))
    assert {r.root for r in variants.rooted(ways).collect()} == {"w37"} and variants.rooted(ways).count() == 37

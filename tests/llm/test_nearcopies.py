"""Near copies of short templated texts: right, in bounded memory, and in time that grows with their number."""

import random
import time

import numpy as np
import pytest

from ostinato.llm import nearcopies


def exact(texts, similarity=0.8, width=5):
    """The least number of each text's component, from all pairs of sets."""
    sets = [frozenset(tuple(t[i : i + width]) for i in range(max(1, len(t) - width + 1))) if t else frozenset() for t in texts]
    label = list(range(len(texts)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return [top(k) for k in range(len(texts))]


def found(spark, texts, **how):
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {x.id: x.component_id for x in nearcopies.groups(docs, **how).collect()}
    return [got[k] for k in range(len(texts))]


def templates(r, n, words, slot, values):
    """Texts that differ in one word at a place from the end; few values make some of them equal."""
    base = [f"t{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        own[-slot] = f"v{k}" if values is None else f"v{r.randrange(values)}"
        out.append(own)
    return out


def mixture(r):
    texts = []
    for words in (4, 5, 6, 9, 12, 17, 24, 27, 30, 38, 45, 60):
        texts += templates(r, 12, words, 3, None) + templates(r, 12, words, 1, 5)
    for _ in range(6):  # several slots, of few values: classes that are similar to some and not to others
        base = [f"m{r.randrange(10**6)}" for _ in range(r.choice([18, 30, 50]))]
        for _ in range(14):
            own = list(base)
            for at in (2, len(base) // 2, len(base) - 3):
                own[at] = f"{own[at]}_{r.randrange(3)}"
            texts.append(own[r.randrange(2) :])
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("how", [{}, {"list_rows": 3}, {"list_rows": 40}])
def test_templates_equal_exact_sets(spark, how):
    texts = mixture(random.Random(5))
    assert found(spark, texts, **how) == exact(texts)


def test_a_class_that_only_a_shorter_text_joins(spark):
    """Texts that are no near copies of each other (17 of 23 shingles), but all of one that lacks their own word."""
    r = random.Random(7)
    texts = templates(r, 60, 24, 3, None)
    short = texts[0][:-3]
    for more in ([], [short]):
        own = texts + more
        want = exact(own)
        assert len(set(want)) == (61 - len(more) * 60 if more else 60)
        for rows in (5, 1000):
            assert found(spark, own, list_rows=rows) == want


def test_small_sets_with_equal_bits_are_decided_by_their_sets(spark):
    r = random.Random(8)
    texts = [[f"w{r.randrange(40)}" for _ in range(r.randint(1, 9))] for _ in range(400)]
    assert found(spark, texts) == exact(texts)


def rows_of(texts, label=None):
    import pyarrow as pa
    import zlib

    own = [np.unique(nearcopies.shingles(np.array([zlib.crc32(w.encode()) * 0x9E3779B97F4A7C15 % 2**64 for w in t], np.uint64), 5)) for t in texts]
    checks = [nearcopies.bits_of(x, nearcopies._ODD).tobytes() for x in own]
    n = len(texts)
    columns = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), np.array([len(x) for x in own]), checks, np.arange(n) if label is None else np.array(label), [x.tobytes() for x in own]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["list", "pair", "node", "size", "check", "label", "own"])


def components(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = sorted((label[a], label[b]))
        label = [x if v == y else v for v in label]
    return label


@pytest.mark.parametrize("bits", [0, nearcopies.BITS_BYTES])
def test_decisions_in_a_task_equal_exact_sets(monkeypatch, bits):
    monkeypatch.setattr(nearcopies, "BITS_BYTES", bits)
    r = random.Random(9)
    for _ in range(6):
        texts = [t for t in mixture(r) if len(t) > 4][:150]
        texts = [list(t) for t in {tuple(t) for t in texts}]
        r.shuffle(texts)
        want = exact(texts)
        # some are joined before, as labels say
        label = [w if r.random() < 0.5 else k for k, w in enumerate(want)]
        batch = rows_of(texts, label)
        pairs = [p for out in nearcopies._decide(iter([batch.slice(0, 40), batch.slice(40)]), 0.8, at_once=64) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        assert components(len(texts), pairs + [(k, x) for k, x in enumerate(label)]) == want


def test_decisions_take_time_in_proportion():
    """Ten thousand unlike texts of one template in one task: one class, whatever their number."""
    for words, slot, near in ((24, 3, 0), (36, 10, 0), (60, 3, 1)):
        seconds = []
        for n in (2500, 10_000):
            batch = rows_of(templates(random.Random(3), n, words, slot, None))
            began = time.process_time()
            assert sum(x.num_rows for x in nearcopies._decide(iter([batch]), 0.8)) == near * (n - 1)
            seconds.append(time.process_time() - began)
        assert seconds[1] < 8 * seconds[0] + 0.5 and seconds[1] < 6


def test_ten_thousand_templated_texts(spark):
    """Texts of several lengths from templates; no two of those of 24 words are near copies, those of 60 are."""
    r = random.Random(4)
    texts = [t for words in (8, 24, 30, 60) for t in templates(r, 2500, words, 3, None)]
    began = time.time()
    got = found(spark, texts)
    assert time.time() - began < 150
    assert got == list(range(7500)) + [7500] * 2500

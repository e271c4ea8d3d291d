"""Near copies are found by lists of their fingerprints; shingles only have what these leave apart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.llm import nearcopies

from .test_nearcopies import components, exact, found, rows_of


def edited(r, n=30, words=300, copies=3, edits=3):
    """Texts of own words, each with copies of which every one has other words at a few places."""
    out = []
    for k in range(n):
        base = [f"w{k}_{r.randrange(10**6)}" for _ in range(words)]
        out.append(base)
        for c in range(copies):
            own = list(base)
            for at in r.sample(range(words), edits):
                own[at] = f"e{c}_{r.randrange(10**6)}"
            out.append(own)
    return out


def no_lists(*args):
    return PRINTS(*args).withColumn("lists", F.array().cast("array<long>"))


PRINTS = nearcopies.prints


@pytest.mark.parametrize("rows", [1000, 3])
def test_fingerprints_find_near_copies_without_shingles(spark, monkeypatch, rows):
    """Copies that are 0.97 like their text share a list with it in 99.6 % (those at 0.90 in 79 %); nothing else is joined."""
    texts = edited(random.Random(1), edits=1)
    want = exact(texts)
    assert len(set(want)) == 30
    assert found(spark, texts, list_rows=rows) == want
    monkeypatch.setattr(nearcopies, "prints", no_lists)
    got = found(spark, texts, list_rows=rows)
    assert all(want[k] == want[c] for k, c in enumerate(got))
    whole = sum(got[4 * k : 4 * k + 4] == [4 * k] * 4 for k in range(30))
    assert whole >= 28


def test_shingles_have_only_what_fingerprints_left(spark, monkeypatch):
    texts = edited(random.Random(2), n=20, edits=1) + edited(random.Random(3), n=20, edits=11)
    seen, plain = [], nearcopies.by_shingles

    def spy(nodes, joined, similarity, list_rows, paths):
        links = plain(nodes, joined, similarity, list_rows, paths)
        label = {r.node: r.component for r in joined.collect()}
        seen.append((len(label), [(r.a, r.b) for r in links.collect() if label.get(r.a, r.a) == label.get(r.b, r.b)]))
        return links

    monkeypatch.setattr(nearcopies, "by_shingles", spy)
    assert found(spark, texts) == exact(texts)
    (joined, again), = seen
    assert joined >= 76 and not again


def test_tally_of_shared_bytes():
    """Only pairs that share so many bytes in place are looked at; all that are surely similar do."""
    texts = edited(random.Random(4), n=10, words=120, edits=1)
    batch = rows_of(texts)
    table = batch.select(["list", "node", "size", "check", "node"])
    check = np.frombuffer(b"".join(batch.column("check").to_pylist()), np.uint8).reshape(len(texts), -1)
    shared = (check[:, None] == check[None]).sum(2)
    links = lambda **how: [(a, b) for out in nearcopies._links(iter([table]), 0.8, pairs=100, **how) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    assert links(shared=65) == []
    got = links(shared=nearcopies.SHARED)
    assert got and all(shared[a, b] >= nearcopies.SHARED for a, b in got if a // 4 == b // 4)
    assert components(len(texts), got) == components(len(texts), links()) == exact(texts)
    # up to `near` differing bits at least so many of 64 bytes are equal, so the tally keeps them
    assert 64 - nearcopies.limits(0.8)[0] >= nearcopies.SHARED

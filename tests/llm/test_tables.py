import hashlib
import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ostinato.llm import components, nearcopies, packing, queries, simhash, substrings

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    seen = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((bytes(c for c, g in zip(t, gone) if not g), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))))
    return out


def copies(n, seed):
    """Texts with passages in common, in different surroundings."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 4)))
    passages = [" ".join(word() for _ in range(r.randint(4, 40))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 25))), r.choice(passages)[r.randint(0, 9) :]]
        texts.append(" ".join(r.sample(parts * r.randint(1, 2), 2)))
    return texts + texts[:5] + ["a" * 100, "ab" * 60, "", "short"]


def check(spark, texts, length, seed):
    rows = list(enumerate(texts))
    got = {r.doc_id: (bytes(r.kept), r.n_spans) for r in substrings.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=length, seed=seed).collect()}
    for (k, _), want in zip(rows, brute([t.encode() for t in texts], length)):
        assert got[k] == want, k


def test_substrings_equal_brute_force(spark):
    check(spark, copies(120, 1), 20, 6)
    check(spark, copies(60, 2), 33, 4)


def test_substrings_of_spread_anchors(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_STRETCHES", 3)
    check(spark, copies(120, 3), 20, 6)


def test_windows_whose_names_clash_are_compared(monkeypatch):
    """With a rolling hash that gives everything one name, bytes decide."""
    class Flat(substrings.Rolling):
        def of(self, sums, start, end):
            return np.zeros(len(np.atleast_1d(start)), np.uint64)

    texts = [b"abcdefghijXYZabcdefgh", b"qbcdefghijXYZabcdefgz", b"mmmmmmmmmmXYZnnnnnnnn"]
    for rolling in (Flat(), substrings.Rolling()):
        got = substrings.grow(texts, np.array([10, 10, 10]), 12, 3, rolling)
        want = [[sum(t[p : p + 12] == u[q : q + 12] and (i, p) != (j, q) for j, u in enumerate(texts) for q in (p,)) > 0 for p in range(len(t) - 11)] for i, t in enumerate(texts)]
        assert [x.tolist() for x in got] == want and any(map(any, want))


def test_stretches_hold_all_windows():
    raw = np.frombuffer("".join(copies(30, 4)).encode(), np.uint8)
    at = np.array([0, 500, 510, len(raw)])
    row, start, n, offset, anchor, whole = substrings.stretches(raw, at, 20, 6, substrings.Rolling())
    windows = [(r, s + k) for r, s, m in zip(row.tolist(), start.tolist(), n.tolist()) for k in range(m)]
    assert windows == [(r, p) for r in range(3) for p in range(max(0, at[r + 1] - at[r] - 19))]


def test_long_texts_come_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(substrings, "_WINDOWS", 100)
    text = "".join(copies(30, 5))[:1000]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], names=["id", "key", "text"])
    whole = text.encode()
    seen = [(lo + k, bytes(raw[k : k + 20])) for _, raw, at, lo in substrings.parts_of(batch, 20) for k in range(len(raw) - 19)]
    assert seen == [(p, whole[p : p + 20]) for p in range(len(whole) - 19)]


def test_substrings_of_odd_rows(spark, odd, none):
    got = substrings.removed(odd).collect()
    assert len(got) == odd.count() and substrings.removed(none).count() == 0
    assert sum(r.n_bytes == 0 for r in got) == 3


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, odd, none):
    docs = queries.read(spark, SF, "documents").select("doc_id", "text")
    r = random.Random(3)
    more = []
    for x in docs.limit(60).collect():
        words = x.text.split()
        for k in range(2):
            own = list(words)
            own[r.randrange(len(own))] = "changed"
            more.append((10**6 + 10 * x.doc_id + k, " ".join(own)))
    df = docs.unionByName(spark.createDataFrame([*more, (7 * 10**6, None), (8 * 10**6, " \t")], "doc_id long, text string"))
    rows = df.collect()
    prints = {x.doc_id: plain_print(x.text or "") for x in rows}
    root = {d: d for d in prints}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3 and top(a) != top(b):
            root[max(top(a), top(b))] = min(top(a), top(b))
    got = {x.doc_id: (int(x.fingerprint, 16), x.component_id) for x in simhash.report(df).collect()}
    assert got == {d: (prints[d], top(d)) for d in prints}
    small = {x.id: x.component_id for x in simhash.groups(df, list_rows=2).collect()}
    assert small == {d: c for d, (_, c) in got.items()}
    assert {x.doc_id for x in simhash.survivors(df, simhash.groups(df)).collect()} == {c for _, c in got.values()}
    assert simhash.groups(odd).count() == odd.count() and simhash.groups(none).count() == 0
    assert simhash.survivors(odd, simhash.groups(odd)).columns == odd.columns and simhash.survivors(none, simhash.groups(none)).count() == 0


def test_links_hold_every_pair_within_three_bits(spark):
    r = random.Random(9)
    prints = set()
    for _ in range(40):
        x = r.getrandbits(64)
        prints |= {x} | {x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))) for _ in range(4)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), list_rows=3)
    found = {r.node: r.component for r in components.components(edges, "a", "b").collect()}
    for (a,), (b,) in itertools.combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
            assert found[a] == found[b]


def test_components_of_a_long_path(spark):
    rows = [(k, k + 1) for k in range(200)] + [(500, 500), (601, 600)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(201)}, 600: 600, 601: 600}


def test_superseded_tables_are_deleted(spark):
    from pathlib import Path

    from ostinato.llm import common, components

    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before, paths = set(folder.iterdir()), []
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    found = components.components(edges, "a", "b", paths=paths)
    assert {p.name for p in set(folder.iterdir()) - before} == {paths[0].rsplit("/", 1)[1]} and len(paths) == 1
    assert {(r.node, r.component) for r in found.collect()} == {(k, 0) for k in range(201)}
    common.dropped(spark, paths)
    assert set(folder.iterdir()) == before and not paths


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(packing.vocabulary())
    docs = queries.read(spark, SF, "documents").select("doc_id", "text").unionByName(odd.filter("doc_id > 1").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.report(docs).collect()
    total, by_doc, by_seq = 0, {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, parts in by_doc.items():
        ids = np.array([*inner.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k, p in enumerate(sorted(parts, key=lambda p: p.piece)):
            own = ids[2048 * k : 2048 * k + 2048]
            assert (p.piece, p.start, p.length, p.ids_crc32) == (k, 2048 * k, len(own), __import__("zlib").crc32(own.tobytes()))
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert len(by_seq) <= 1.02 * -(-total // 2048) + 1
    assert packing.pack(none, packing.vocabulary()).count() == 0
    assert packing.pack(odd, packing.vocabulary()).filter("piece = 0").count() == odd.count()


def fewest(sizes, capacity):
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                go(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best[0]


def test_dominance_fixes_no_worse_sets():
    r = random.Random(4)
    for _ in range(150):
        sizes = sorted((r.randint(1, 20) for _ in range(r.randint(1, 10))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        fixed, rest = packing.reduce_by_dominance(counts, 20)
        left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + fewest(left, 20) == fewest(sizes, 20)
        every = sum((k * times for pattern, times in packing.plan(counts, 20) for _, k in pattern))
        assert every == len(sizes)


def test_digest_of_what_is_kept(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.kept_sha256 for r in substrings.report(df).collect()} == {1: hashlib.sha256(b"abc").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_near_copies_of_four_fifths(spark, odd, none):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows, sets = [], {}
    for k in range(60):
        base = [word() for _ in range(r.randint(60, 300))]
        for j, share in enumerate((0, 0.01, 0.03, 0.3)):
            own = [w if r.random() >= share else word() for w in base]
            rows.append((10 * k + j, " ".join(own).title()))
            sets[10 * k + j] = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
    found = {x.id: x.component_id for x in nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b and a // 10 == b // 10]
    high, low = [p for p in pairs if p[2] >= 0.85], [p for p in pairs if p[2] < 0.5]
    assert len(high) > 50 and sum(found[a] == found[b] for a, b, _ in high) >= 0.98 * len(high)
    assert len(low) > 50 and not any(found[a] == found[b] for a, b, _ in low)
    assert all(found[d] // 10 == d // 10 for d in found)
    few = {x.id: x.component_id for x in nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string"), list_rows=2).collect()}
    assert few == found
    assert nearcopies.groups(odd).count() == odd.count() and nearcopies.groups(none).count() == 0


def test_near_copies_with_null_and_repeated_ids(spark):
    r = random.Random(12)
    long = [" ".join(f"w{r.randrange(10**6)}" for _ in range(300)) for _ in range(5)]
    near = long[0] + " end"
    rows = [(None, long[0]), (None, long[1]), (None, near), (7, long[2]), (7, long[3]), (9, long[2] + " end"), (3, long[4]), (3, long[4]), (11, None), (None, ""), (None, long[4])]
    got = nearcopies.clean(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, id string"))
    assert got.columns == ["doc_id", "text", "id"]
    found = [(x.doc_id, x.text) for x in got.collect()]
    assert len(found) == 6 and len(set(found)) == 6
    assert {(None, long[1]), (7, long[2]), (7, long[3]), (3, long[4]), (11, None)} <= set(found)
    assert len({(None, long[0]), (None, near)} & set(found)) == 1


def edited(r, kind, similarity, n=200):
    """A text and its copy with one edited stretch, whose shingle sets are about that similar."""
    word = lambda: f"w{r.randrange(10**6)}"
    base, m = [word() for _ in range(n)], n - 4
    if kind == "appended":
        return base, base + [word() for _ in range(int(m / similarity) - m)]
    lost = int(m - 2 * m * similarity / (1 + similarity))  # a stretch of k words is in k + 4 shingles
    return base, base[:60] + [word() for _ in range(lost - 4)] + base[60 + lost - 4 :]


def jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a, b))
    return len(a & b) / len(a | b)


def test_index_of_near_copies_has_all_pairs(spark):
    r = random.Random(21)
    pairs = [edited(r, kind, s) for kind in ("replaced", "appended") for s in (0.8, 0.82, 0.85) for _ in range(20)]
    assert all(0.8 <= jaccard(*p) < 0.87 for p in pairs)
    docs = spark.createDataFrame([(2 * k + j, " ".join(t)) for k, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    lists = {x.id: set(x.lists) for x in nearcopies.prints(docs, "doc_id", "text").collect()}
    assert all(lists[2 * k] & lists[2 * k + 1] for k in range(len(pairs)))


def test_near_copies_are_those_of_exact_sets(spark):
    r = random.Random(22)
    word = lambda: f"w{r.randrange(10**6)}"
    line, texts = [f"l{k}" for k in range(12)], []
    for k in range(60):  # a footer makes no near copies
        texts.append(line * 10 + [word() for _ in range(60)])
        texts += edited(r, ("replaced", "appended")[k % 2], (0.74, 0.78, 0.81, 0.85)[k // 2 % 4])
    for k in range(20):  # small sets, whose bits tell little
        texts.append([word() for _ in range(k)])
        texts += [texts[-1] + [word()], texts[-1] + [word(), word()]]
    n = len(texts)
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            if set(texts[a]) & set(texts[b]) and jaccard(texts[a], texts[b]) >= 0.8 or not texts[a] + texts[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string")
    got = {x.id: x.component_id for x in nearcopies.groups(docs).collect()}
    assert [got[k] for k in range(n)] == label


def test_one_copy_of_a_stretch_is_compared(spark, monkeypatch):
    r = random.Random(23)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(120))
    near = text[:400] + "#" + text[401:]
    sent, third = [], substrings._third

    def counted(cold, length, seed):
        sent.append(cold.groupBy("anchor", "bytes").count().agg(F.max("count")).first()[0])
        return third(cold, length, seed)

    monkeypatch.setattr(substrings, "_third", counted)
    want = [len(kept) for kept, _ in brute([t.encode() for t in (text, text, near)], 200)]
    for ids in (range(200), [None] * 200):
        rows = [(k, text) for k in ids] + [(1000, near)]
        got = [(r.n_bytes, len(r.kept)) for r in substrings.removed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), "doc_id", "text").collect()]
        assert sorted(k for _, k in got) == sorted([want[0]] * 200 + [want[2]])
    assert max(sent) <= 2  # one for each task


def test_ids_of_words_that_polynomial_hashes_confuse():
    """The first 1024 letters of the Thue-Morse word and their complement have equal sums modulo 2**64 for any odd base."""
    from ostinato.llm.common import as_bytes

    import pyarrow as pa

    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    cut = packing.WordTokenizer.LONG
    pairs = [(one, two), (one[:cut], two[:cut]), (one[: cut + 1], two[: cut + 1]), (one[:8], two[:8]), ("a\0", "a"), ("é" * 40, "è" * 40)]
    words = packing.WordTokenizer(packing.vocabulary(), limit=9)  # forgets all now and then
    want = lambda t: words.inner.encode(t, add_special_tokens=False).ids
    for _ in range(2):
        for a, b in pairs:
            for texts in ([f"{a} x {b}", b], [b], [a, f"{b}\n{a.upper()}"]):
                assert [x.tolist() for x in words.texts(*as_bytes(pa.array(texts)))] == [want(t) for t in texts]


def test_sets_that_clash_are_told_apart(spark, monkeypatch):
    """Nodes are sums of 64-bit hashes; here all sets have one of three nodes, and the twins tell them apart."""
    r = random.Random(31)
    base = [[f"w{r.randrange(10**6)}" for _ in range(80)] for _ in range(9)]
    texts = [" ".join(x) for x in base] + [" ".join([*x[:-1], "end"]) for x in base] + [" ".join(base[0])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {x.id: x.component_id for x in nearcopies.groups(docs).collect()}
    plain = nearcopies.prints

    def clash(*args):
        found = plain(*args)
        return found.withColumn("node", F.pmod("node", F.lit(3)))

    sets = nearcopies.sets
    monkeypatch.setattr(nearcopies, "prints", clash)
    monkeypatch.setattr(nearcopies, "sets", lambda *args: sets(*args).withColumn("node", F.pmod("node", F.lit(3))))
    found = clash(docs, "doc_id", "text")
    assert found.select("node").distinct().count() == 3
    assert nearcopies.told_apart(found, nearcopies.clashes(found)).select("node").distinct().count() == 18
    assert want == {k: k % 9 for k in range(18)} | {18: 0}
    assert {x.id: x.component_id for x in nearcopies.groups(docs).collect()} == want

"""Near copies by longer SimHash fingerprints: five-word shingles with a similarity of 0.8 or more.

Three of 64 bits only join texts that are nearly equal, so fingerprints have 512 bits, of the distinct five-word
shingles.  They are found as op9's are: an inverted index has a posting list for each value of three bytes in place
(`pieces`); pairs in a list are tallied by the bytes that they share in place; those with enough are verified, bit by bit where
the bits tell that they are surely similar or surely not (4.5 deviations from 0.8), else by their shingle sets.

No number of pieces of a fingerprint that fits the disk finds all pairs at 0.8 (24-bit pieces: some 350 for 99.9 %),
so an exact way for the rest follows: pairs that the fingerprints left in different components are looked for by the shingles
themselves.  In any order of all shingles, two sets with a Jaccard similarity
of t share one of the first m - ceil(t m) + 1 of m, whatever the edit was.  The order takes shingles
that a sample of texts has often last, which keeps lists short; no order can lose a pair.  Lists that are in one component
by then have nothing left to find.  In the others bits decide what they can, and shingle sets the rest.  Where a list has
few such pairs, each is decided by itself, and what is false is gone.  A list with more, or a long one,
as texts from a template make, is a dense one: its nodes form clusters, in which each is held against one
of them, and then against those that are still apart.  There, nodes that have the same of the shingles that
occur twice in the cluster are one class, as they are equally similar to all others: however many fill
a template with words of their own, they are one class.  Texts of equal shingle sets are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, dropped, slices, text_column, word_bounds, word_hashes, written
from .components import components
from .simhash import _forest, row_key, survivors

CHECK_WORDS, SHINGLE = 8, 5
#: Bytes in place that name a posting list of fingerprints, and bytes in place that two of a list must share to be verified:
#: of 64, pairs at 0.8 that share three have 19 on average and fewer than 6 about once in a million, unlike ones 3.2 and 6 or more in 0.2 %.
PIECE, SHARED = 3, 6
#: One of so many texts is looked at for frequent shingles; those that so many of them have count; the most frequent ones go to all tasks.
SAMPLE, OFTEN, MOST_OFTEN = 16, 4, 200_000
#: Of smaller sets the bits tell too little; their pairs are decided by the sets.
SMALL = 32
#: A list with more undecided pairs a node is dense.
PAIRS = 4
SURE, OPEN, DENSE = 0, 1, 2
#: Bytes of a task's table of sets as bits; sets beyond that are compared pair by pair.
BITS_BYTES = 128 << 20
_LANES = np.uint64(0x0101010101010101)
_ODD = np.random.default_rng(29).integers(1, 1 << 63, CHECK_WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[9:14] = 32


def limits(similarity: float, bits: int = 64 * CHECK_WORDS, spread: float = 4.5, wide: float = 1.05) -> tuple[int, int]:
    """Differing bits up to which a pair is surely that similar, and from which it surely isn't: `spread` deviations off the mean.

    Small sets differ in up to `wide` times as many bits as the angle between them says (from `SMALL` shingles on).
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    q = wide * p
    return int(bits * p - spread * np.sqrt(bits * p * (1 - p))), int(bits * q + spread * np.sqrt(bits * q * (1 - q))) + 1


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` word hashes (of all words, if fewer)."""
    n = max(1, len(words) - width + 1) if len(words) else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(29))


def bits_of(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Fingerprint words: a bit is 1 if more than half of the mixed hashes have it; each of `odd` mixes for one word."""
    n, out = len(hashes), np.zeros(len(odd), np.uint64)
    for at in range(0, n, 1 << 15):
        x = hashes[None, at : at + (1 << 15)] * odd[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        groups = np.arange(0, x.shape[1], 255)
        sums = [np.add.reduceat((x >> np.uint64(b)) & _LANES, groups, axis=1).view(np.uint8).reshape(len(odd), -1, 8).sum(1, dtype=np.int64) for b in range(8)]
        total = np.stack(sums, 2) if at == 0 else total + np.stack(sums, 2)
    if n:
        out = np.packbits(2 * total.reshape(len(odd), 64) > n, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def texts_of(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches, with the hashes of the words of each row; words stand between white space, A-Z in lower case."""
    for batch in batches:
        for part in slices(batch, limit=1 << 19):
            raw, at = as_bytes(part.column(text))
            lower = _TABLE[raw]
            start, end, row = word_bounds(lower, at)
            words = word_hashes(lower, start, end)
            yield part, np.split(words, np.searchsorted(row, np.arange(1, part.num_rows)))


def _twin(own: np.ndarray) -> np.uint64:
    x = (own ^ (own >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))).sum()


def clashes(found: DataFrame) -> DataFrame | None:
    """(node, least): nodes that different sets have (their twins tell); None if there are none, as a rule."""
    same = found.groupBy("node").agg(F.min("twin").alias("least"), F.max("twin").alias("most")).filter("least <> most").select("node", "least")
    return None if same.isEmpty() else same


def told_apart(found: DataFrame, same: DataFrame | None) -> DataFrame:
    """found with another node for all but one of the sets that clash."""
    if same is None:
        return found
    node = F.when(F.col("twin") > F.col("least"), F.xxhash64("node", "twin")).otherwise(F.col("node"))
    return found.join(same, "node", "left").withColumn("node", node).select(*found.columns)


def prefix(own: np.ndarray, similarity: float, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those of a set of shingles of which any set that similar has one too: the first by sampled count, then by hash."""
    m = len(own)
    at = np.minimum(np.searchsorted(often, own), max(len(often) - 1, 0))
    rank = np.where(often[at] == own, counts[at], 0) if len(often) else np.zeros(m, np.int64)
    return own[np.lexsort((own, rank))[: m - int(np.ceil(similarity * m - 1e-9)) + 1]] if m else own


def frequent(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in the order of their hashes, with their counts in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in texts_of(batches, 0):
            found = [np.unique(shingles(words, SHINGLE)) for words in texts]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])

    source = docs.select(text_column(docs, text_col))
    sample = source.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).dropDuplicates(["text"])
    seen = sample.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    rows = seen.orderBy(F.desc("n"), "shingle").limit(MOST_OFTEN).toArrow()  # MOST_OFTEN at most
    hashes, counts = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prints(docs: DataFrame, id_col: str, text_col: str, similarity: float = 0.8) -> DataFrame:
    """(id, digest, node, twin, size, lists, check): texts of equal shingle sets have the same node and the same twin, two sums of unlike hashes."""
    often = docs.sparkSession.sparkContext.broadcast(frequent(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches, 2):
            nodes, twins, sizes, lists, checks = [], [], [], [], []
            for words in texts:
                own = np.unique(shingles(words, SHINGLE))
                nodes.append(own.sum())
                twins.append(_twin(own))
                sizes.append(len(own))
                lists.append(prefix(own, similarity, *often.value).view(np.int64))
                checks.append(bits_of(own, _ODD).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, twins)), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(checks, pa.binary())],
                names=["id", "digest", "node", "twin", "size", "lists", "check"],
            )

    source = docs.select(docs[id_col].alias("id"), text_column(docs, text_col))
    source = source.select("id", F.xxhash64("text").alias("digest"), "text")
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, digest long, node long, twin long, size long, lists array<long>, check binary")


def sets(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, twin, own): the shingle sets of texts whose xxhash64 is a `digest` of wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in texts_of(batches, 0):
            found = [np.unique(shingles(words, SHINGLE)) for words in texts]
            names = [pa.array(np.array([f(own) for own in found], np.uint64).view(np.int64)) for f in (np.sum, _twin)]
            yield pa.RecordBatch.from_arrays([*names, pa.array([own.tobytes() for own in found], pa.binary())], names=["node", "twin", "own"])

    source = docs.select(text_column(docs, text_col))
    few = source.join(wanted.distinct(), F.xxhash64("text") == F.col("digest"), "left_semi")
    return few.mapInArrow(run, "node long, twin long, own binary").dropDuplicates(["node", "twin"])


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, one, two) those whose sets are that similar."""
    for batch in batches:
        good = []
        for i, (one, two) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                good.append(i)
        yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))


def _could(small: np.ndarray, large: np.ndarray, most: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes with at most so many in common can be that similar."""
    return most >= similarity * (small + large - most) - 1e-9


def _whole_lists(batches: Iterator[pa.RecordBatch], columns: int, out) -> Iterator[pa.RecordBatch]:
    """`out` of tables of whole lists; rows come sorted by their first `columns`, and a list may go over several batches."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        table = now if held is None else pa.concat_tables([held, now])
        if not table.num_rows:
            continue
        lists = np.stack([table.column(k).to_numpy() for k in range(columns)], 1)
        last = int(np.argmax((lists == lists[-1]).all(1)))
        if last:
            yield out(table.slice(0, last))
        held = table.slice(last)
    if held is not None and held.num_rows > 1:
        yield out(held)


def _groups(table: pa.Table, columns: int) -> np.ndarray:
    lists = np.stack([table.column(k).to_numpy() for k in range(columns)], 1)
    return np.cumsum(np.concatenate([[False], (lists[1:] != lists[:-1]).any(1)]))


def _checks(table: pa.Table, column: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), np.uint64).reshape(table.num_rows, -1)


def _links(batches: Iterator[pa.RecordBatch], similarity: float, pairs: int = PAIRS, shared: int = 0) -> Iterator[pa.RecordBatch]:
    """Links (a, b, kind) between the rows (list, node, size, check, label) of each list that have different labels.

    Pairs are tallied by the bytes of their fingerprints that are equal in place; only those with `shared` or more are looked at.
    SURE: a forest of what is surely similar.  OPEN: all pairs to decide between its trees, of a list with at
    most `pairs` of them a node.  DENSE: a forest of those of other lists, with all nodes that have any.
    """
    near, far = limits(similarity)

    def out(table: pa.Table) -> pa.RecordBatch:
        group, (node, size, label), check = _groups(table, 1), (table.column(k).to_numpy() for k in (1, 2, 4)), _checks(table, 3)
        opened, many = np.zeros(int(group[-1]) + 1, np.int64), pairs * np.bincount(group)
        none = np.zeros(0, np.int64)
        a, b, dense_a, dense_b, c, d = none, none, none, none, [none], [none]
        left, step = np.arange(len(node)), 1
        while len(left := left[left + step < len(node)]) and len(left := left[group[left] == group[left + step]]):
            at = left[label[left] != label[left + step]]
            differ = check[at] ^ check[at + step]
            if shared:
                enough = (differ.view(np.uint8) == 0).sum(1) >= shared
                at, differ = at[enough], differ[enough]
            differ = np.bitwise_count(differ).sum(1)
            small, large = np.minimum(size[at], size[at + step]), np.maximum(size[at], size[at + step])
            sure = (differ <= near) & (small >= SMALL)
            open_ = ~sure & _could(small, large, small - (small == large), similarity) & ((differ < far) | (small < SMALL))
            a, b = np.concatenate([a, node[at[sure]]]), np.concatenate([b, node[at[sure] + step]])
            at = at[open_]
            opened += np.bincount(group[at], minlength=len(opened))
            full = opened[group[at]] > many[group[at]]
            dense_a, dense_b = np.concatenate([dense_a, node[at[full]]]), np.concatenate([dense_b, node[at[full] + step]])
            c.append(at[~full])
            d.append(at[~full] + step)
            if len(a) > 1 << 20:
                a, b = _forest(a, b)
            if len(dense_a) > 1 << 20:
                dense_a, dense_b = _forest(dense_a, dense_b)
            step += 1
        a, b = _forest(a, b)
        c, d = np.concatenate(c), np.concatenate(d)
        order = np.argsort(a)  # each node of the forest is once on the left, with its root

        def root(x: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(a, x, sorter=order), max(len(a) - 1, 0))
            return np.where(a[order[at]] == x, b[order[at]], x) if len(a) else x

        full = opened[group[c]] > many[group[c]]  # pairs seen before their list turned out to be dense
        dense_a, dense_b = np.concatenate([dense_a, node[c[full]]]), np.concatenate([dense_b, node[d[full]]])
        c, d = node[c[~full]], node[d[~full]]
        apart, dense = root(c) != root(d), root(dense_a) != root(dense_b)
        c, d = c[apart], d[apart]
        found = np.unique(np.stack([np.minimum(c, d), np.maximum(c, d)], 1), axis=0)
        e, f = _forest(dense_a[dense], dense_b[dense])
        kinds = np.repeat(np.array([SURE, OPEN, DENSE], np.int32), [len(a), len(found), len(e)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, found[:, 0], e])), pa.array(np.concatenate([b, found[:, 1], f])), pa.array(kinds)], names=["a", "b", "kind"])

    yield from _whole_lists(batches, 1, out)


def _kept(own: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, number) of all shingles that occur in two or more rows of their group, by row, and how many numbers there are."""
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    row = np.repeat(np.arange(len(own)), sizes)
    flat = np.concatenate([np.zeros(0, np.uint64), *own]) ^ (group[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, number, n = np.unique(flat, return_inverse=True, return_counts=True)
    keep = n[number] > 1
    dense = np.cumsum(n > 1) - 1
    return row[keep], dense[number[keep]], int((n > 1).sum())


def _classes(row: np.ndarray, number: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each class, class of each row, how many kept shingles each row has).

    Rows of a class have the same kept shingles and size: whatever else they have is theirs alone.
    """
    mixed = number.astype(np.uint64) + np.uint64(1)
    sums = []
    at = np.searchsorted(row, np.arange(len(size) + 1))
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = mixed * np.uint64(odd)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h ^ (h >> np.uint64(29)))])
        sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    k = np.diff(at)
    _, first, which = np.unique(np.stack([*sums, k, size, group], 1), axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return first[order], place[which.ravel()], k


def _decide(batches: Iterator[pa.RecordBatch], similarity: float, at_once: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """True links (a, b), as a forest, between rows (list, pair, node, size, check, label, own) of each list that have different labels; `own` are the sets.

    Classes are compared in place of their rows, a bounded number of pairs at a time, and what is
    joined by then is passed over.
    """
    far = limits(similarity)[1]

    def out(table: pa.Table) -> pa.RecordBatch:
        group, (node, size, known), check = _groups(table, 2), (table.column(k).to_numpy() for k in (2, 3, 5)), _checks(table, 4)
        own = [np.frombuffer(x, np.uint64) for x in table.column(6).to_pylist()]
        row, number, width = _kept(own, group)
        first, which, k = _classes(row, number, size, group)
        names, known = np.unique(known, return_inverse=True)
        low, high = np.full(len(first), len(names)), np.full(len(first), -1)
        np.minimum.at(low, which, known)
        np.maximum.at(high, which, known)
        mixed = low < high  # of different labels, so this class has one of its own until it is joined
        label = np.where(mixed, len(names) + np.arange(len(first)), low)
        root = np.arange(len(names) + len(first))
        n, k, group_of = size[first], k[first], group[first]
        words = -(-width // 64)
        bits = None
        if len(first) * words * 8 <= BITS_BYTES:
            bits, place = np.zeros(len(first) * words, np.uint64), np.full(len(size), -1)
            place[first] = np.arange(len(first))
            mine = place[row] >= 0
            np.bitwise_or.at(bits, place[row[mine]] * words + (number[mine] >> 6), np.uint64(1) << (number[mine] & 63).astype(np.uint64))
            bits = bits.reshape(len(first), words)
        joined = mixed & (k >= similarity * (2 * n - k) - 1e-9)  # its own rows are similar
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            if bits is None:
                return np.array([len(np.intersect1d(own[x], own[y], assume_unique=True)) for x, y in zip(first[i].tolist(), first[j].tolist(), strict=True)], np.int64)
            step = max(1, (1 << 22) // max(words, 1))
            return np.concatenate([np.bitwise_count(bits[i[s : s + step]] & bits[j[s : s + step]]).sum(1, dtype=np.int64) for s in range(0, len(i), step)])

        def decided(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal a, b, root
            for s in range(0, len(i), at_once if bits is not None else 1 << 10):
                x, y = (e[s : s + (at_once if bits is not None else 1 << 10)] for e in (i, j))
                apart = root[label[x]] != root[label[y]]
                x, y = x[apart], y[apart]
                if not len(x):
                    continue
                both = common(x, y)
                good = both >= similarity * (n[x] + n[y] - both) - 1e-9
                x, y = x[good], y[good]
                joined[x] = joined[y] = True
                a, b = _forest(np.concatenate([a, node[first[x]]]), np.concatenate([b, node[first[y]]]))
                child, top = _forest(root[label[x]], root[label[y]])
                way = np.arange(len(root))
                way[child] = top
                root = way[root]

        c, d, waiting = [], [], 0
        left, step = np.arange(len(first)), 1
        while len(left := left[left + step < len(first)]) and len(left := left[group_of[left] == group_of[left + step]]):
            i = left[root[label[left]] != root[label[left + step]]]
            j = i + step
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            open_ = _could(small, large, np.minimum(k[i], k[j]), similarity)
            i, j, small = i[open_], j[open_], small[open_]
            open_ = (small < SMALL) | (np.bitwise_count(check[first[i]] ^ check[first[j]]).sum(1) < far)
            c.append(i[open_])
            d.append(j[open_])
            waiting += len(c[-1])
            if waiting >= at_once:
                decided(np.concatenate(c), np.concatenate(d))
                c, d, waiting = [], [], 0
            step += 1
        if waiting:
            decided(np.concatenate(c), np.concatenate(d))
        star = np.flatnonzero((joined & mixed)[which] & (first[which] != np.arange(len(which))))
        a, b = _forest(np.concatenate([a, node[star]]), np.concatenate([b, node[first[which[star]]]]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    yield from _whole_lists(batches, 2, out)


def _collapsed(rows: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (list, node, size, check, label, own) with one row a class, and (node, rep, joined) of the others.

    The same as `_classes`, for clusters that no task holds: shingles are counted by cluster.  A class of several
    labels gets one of its own, so that no pair of it is passed over; `joined`: its rows are similar to each other.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate([np.zeros(0, np.int64), *own]))], names=["list", "node", "shingle"])

    each = rows.select("list", "node", "own").mapInArrow(flat, "list long, node long, shingle long")
    shared = each.groupBy("list", "shingle").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    mix = lambda k: F.bit_xor(F.xxhash64("shingle", F.lit(k)))
    kept = each.join(shared, ["list", "shingle"]).groupBy("list", "node").agg(F.count("*").alias("k"), mix(1).alias("x"), mix(2).alias("y"))
    facts = written(rows.join(kept, ["list", "node"]).select("list", "node", "label", "size", "k", "x", "y"))
    own = ["list", "size", "k", "x", "y"]
    classes = facts.groupBy(*own).agg(F.min("node").alias("rep"), F.min("label").alias("low"), F.max("label").alias("high"))
    label = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.xxhash64("rep", F.lit(7)))
    alike = F.col("k") >= similarity * (2 * F.col("size") - F.col("k")) - 1e-9
    members = facts.join(classes.filter("low <> high"), own).filter("node <> rep").select("node", "rep", alike.alias("joined"))
    few = rows.drop("label").join(classes.select("list", F.col("rep").alias("node"), label.alias("label")), ["list", "node"])
    return few.select(*rows.columns), members


def _dealt(listed: DataFrame, list_rows: int, facts: DataFrame) -> DataFrame:
    """(list, pair, node, ...) from rows (list, node, ..., n) of lists of n and facts of nodes: larger lists come as pairs of their parts, sorted."""
    rest = [c for c in listed.columns if c not in ("list", "n")]
    parts = F.ceil(F.col("n") / list_rows).cast("long")
    rows = listed.withColumn("_parts", parts).withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts"))).join(facts, "node")
    dealt = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    pair = F.least("_part", "_other") * F.col("_parts") + F.greatest("_part", "_other")
    own = [c for c in facts.columns if c != "node"]
    return dealt.select("list", pair.alias("pair"), *rest, *own).repartition("list", "pair").sortWithinPartitions("list", "pair", "node")


def _labelled(members: DataFrame, dense: DataFrame, joined: DataFrame, paths: list[str]) -> DataFrame:
    """(list, node, label) of the nodes of dense links: their component so far, and the cluster that links of other components make of it."""
    label = lambda x, name: F.coalesce(F.col(x), F.col(name))
    ends = dense.join(joined.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(joined.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    between = ends.select(label("ca", "a").alias("a"), label("cb", "b").alias("b")).filter("a <> b").distinct()
    clusters = components(between, "a", "b", paths=paths).select(F.col("node").alias("label"), F.col("component").alias("list"))
    return members.join(joined, "node", "left").select("node", label("component", "node").alias("label")).join(clusters, "label").select("list", "node", "label")


def _clusters(members: DataFrame, dense: DataFrame, joined: DataFrame, facts: DataFrame, similarity: float, part_rows: int, paths: list[str]) -> DataFrame:
    """(node, component) of `joined` and of the true links between nodes of dense lists; facts: (node, size, check, own).

    Each node is held against one of its cluster, which joins most near copies in a pass.  Of what is still
    apart, classes are compared, in parts of `part_rows` where there are more.
    """
    as_links = lambda df: df.select(F.col("node").alias("a"), F.col("component").alias("b"))
    rows = written(_labelled(members, dense, joined, paths).join(facts, "node"), paths)
    hubs = rows.groupBy("list").agg(F.min_by(F.struct("node", "label", "own"), "node").alias("hub"))
    held = rows.join(hubs, "list").filter("label <> hub.label").select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("own").alias("one"), F.col("hub.own").alias("two"))
    first = written(held.mapInArrow(lambda batches: _similar(batches, similarity), "a long, b long"), paths)
    if not first.isEmpty():
        joined = components(as_links(joined).unionByName(first), "a", "b", paths=paths)
        now = joined.withColumnRenamed("component", "now")
        rows = rows.join(now, "node", "left").withColumn("label", F.coalesce("now", "label")).select("list", "node", "size", "check", "label", "own")
        # a cluster that is one component by now has nothing left to decide
        apart = rows.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("list")
        rows = written(rows.join(apart, "list", "left_semi"), paths)
    counts = written(rows.groupBy("list").agg(F.count("*").alias("n")), paths)
    members_of = None
    large = counts.filter(F.col("n") > part_rows)
    if not large.isEmpty():
        few, members_of = _collapsed(rows.join(large, "list", "left_semi"), similarity)
        members_of = written(members_of, paths)
        rows = written(rows.join(large, "list", "left_anti").unionByName(few), paths)
        counts = rows.groupBy("list").agg(F.count("*").alias("n"))
    apart = _dealt(rows.select("list", "node", "label").join(counts, "list"), part_rows, rows.select("node", "size", "check", "own"))
    true = written(apart.select("list", "pair", "node", "size", "check", "label", "own").mapInArrow(lambda batches: _decide(batches, similarity), "a long, b long"), paths)
    links = true
    if members_of is not None:
        met = true.select(F.col("a").alias("rep")).unionByName(true.select(F.col("b").alias("rep"))).distinct()
        stars = members_of.filter("joined").unionByName(members_of.filter("NOT joined").join(met, "rep", "left_semi").select("node", "rep", "joined"))
        links = links.unionByName(stars.select(F.col("node").alias("a"), F.col("rep").alias("b")))
    return joined if links.isEmpty() else components(as_links(joined).unionByName(links), "a", "b", paths=paths)


def pieces(check: Column) -> Column:
    """Names of the lists of a fingerprint: each `PIECE` bytes of it with their place."""
    return F.array(*[F.xxhash64(F.lit(k), F.substring(check, PIECE * k + 1, PIECE)) for k in range(8 * CHECK_WORDS // PIECE)])


def by_fingerprints(facts: DataFrame, similarity: float, list_rows: int) -> DataFrame:
    """Links (a, b, kind), SURE or OPEN, of nodes (node, size, check) that meet in a positional list.

    A list of more than `list_rows` nodes is dealt to parts, each with the list's least node besides its own, so
    that a group of near copies is joined through that one.
    """
    lists = facts.select(F.explode(pieces(F.col("check"))).alias("list"), "node")
    counts = lists.groupBy("list").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1")
    parts = F.ceil(F.col("n") / list_rows).cast("long")
    own = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), parts)))
    dealt = lists.join(counts, "list").select("list", "node", F.explode(own).alias("part")).select(F.xxhash64("list", "part").alias("list"), "node")
    rows = dealt.join(facts, "node").select("list", "node", "size", "check", F.col("node").alias("label"))
    rows = rows.repartition("list").sortWithinPartitions("list", "node")
    met = rows.mapInArrow(lambda batches: _links(batches, similarity, shared=SHARED), "a long, b long, kind int")
    return met.filter(F.col("kind") != DENSE)  # dense lists are left to the shingles


def by_shingles(nodes: DataFrame, joined: DataFrame, similarity: float, list_rows: int, paths: list[str]) -> DataFrame:
    """Links (a, b, kind) of nodes (node, size, lists, check) that share one of their first shingles and aren't in one component of `joined`."""
    label = joined.select(F.col("node").alias("own"), F.col("component").alias("label"))
    known = nodes.join(label, F.col("node") == F.col("own"), "left").withColumn("label", F.coalesce("label", "node")).drop("own")
    facts = known.select("node", "size", "check", "label")
    postings = known.select(F.explode("lists").alias("list"), "node", "label")
    # only lists of several components count, and only their postings meet the fingerprints
    counts = postings.groupBy("list").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").drop("high")
    shared = written(postings.drop("label").join(counts, "list"), paths)
    near = shared.filter(F.col("n") <= list_rows).join(facts, "node").select("list", "node", "size", "check", "label").repartition("list").sortWithinPartitions("list", "node")
    met = near.mapInArrow(lambda batches: _links(batches, similarity), "a long, b long, kind int")
    # `low` is a node too, of a component that the list has
    long = shared.filter(F.col("n") > list_rows).filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"), F.lit(DENSE).alias("kind"))
    return met.unionByName(long)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, list_rows: int = 1000) -> DataFrame:
    """(id, component_id) of every row; component_id is the smallest id that links reach.

    Null and empty texts are equal; a component that only has null ids has a null component_id.  Very
    long texts count with all their shingles; repeated rows are in one component; ties of similarity
    at the limit are links; other columns don't matter; an empty table gives none.

    Lists of fingerprints join what is verified there.  Lists of shingles have what may be left between these components; pairs
    that bits leave open are decided by their sets, and then the clusters of dense lists.  Pairs are looked at inside tasks, and only forests
    leave them.  Tables between these steps are deleted when the last links are written.
    """
    steps: list[str] = []
    found = written(prints(docs, id_col, text_col, similarity), steps)
    same = clashes(found)
    found = told_apart(found, same)
    nodes = found.dropDuplicates(["node"]).select("node", "size", "lists", "check")
    facts = nodes.select("node", "size", "check")
    ends = lambda df: df.select(F.col("a").alias("node")).unionByName(df.select(F.col("b").alias("node")))
    of = lambda links, kind: links.filter(F.col("kind") == kind).select("a", "b")

    def verified(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """True links (a, b), of those the bits leave open by their sets; the sets (node, own) of nodes of open and dense links."""
        left = of(links, OPEN).distinct()
        open_ = written(ends(links.filter(F.col("kind") != SURE)).distinct(), steps)
        digests = found.join(open_, "node", "left_semi").groupBy("node").agg(F.min("digest").alias("digest")).select("digest")
        own = written(told_apart(sets(docs, text_col, digests), same).select("node", "own"), steps)
        pairs = left.join(own.select(F.col("node").alias("a"), F.col("own").alias("one")), "a").join(own.select(F.col("node").alias("b"), F.col("own").alias("two")), "b")
        alike = pairs.select("a", "b", "one", "two").mapInArrow(lambda batches: _similar(batches, similarity), "a long, b long")
        return of(links, SURE).unionByName(alike), own

    # plans stay short, for the driver's sake, as each step is written
    true, _ = verified(written(by_fingerprints(facts, similarity, list_rows), steps))
    joined = components(true, "a", "b", paths=steps)
    links = written(by_shingles(nodes, joined, similarity, list_rows, steps), steps)
    true, own = verified(links)
    joined = components(true.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b", paths=steps)
    dense = of(links, DENSE).distinct()
    if not dense.isEmpty():
        joined = _clusters(written(ends(dense).distinct(), steps), dense, joined, facts.join(own, "node"), similarity, 4 * list_rows, steps)
    joined = joined.withColumnRenamed("node", "n")
    least = found.groupBy("node").agg(F.min("id").alias("least"))
    per = least.join(joined, F.col("node") == F.col("n"), "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    small = per.groupBy("component").agg(F.min("least").alias("component_id"))
    out = written(found.select("id", "node").join(per.join(small, "component").select("node", "component_id"), "node").select("id", "component_id"))
    dropped(docs.sparkSession, steps)
    return out


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each group of near copies, with its own columns; of several the one with the smallest id.

    Ids may be null or repeated: rows are told apart by id and text, so no text is lost to another's
    id.  Null and empty texts are one group; an empty table gives an empty one.
    """
    keyed = docs.select(row_key(docs, id_col, text_col).alias("id"), docs[text_col].alias("text"))
    return survivors(docs, groups(keyed, "id", "text", **how), id_col, text_col, by_row=True)

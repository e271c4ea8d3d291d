"""SimHash near-duplicates through an inverted index over the bytes of fingerprints.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so
they share at least 5 bytes in place.  The index has a posting list for each value of 4 bytes
at the places of a block of the Steiner system S(3, 4, 8): any 5 of 8 places hold one of its
14 blocks, so every such pair meets in a list, and lists stay short.  Pairs in a list are
tallied by their shared positional bytes; those with 5 or more are verified bit by bit.

Lists of single bytes would be the plainest index, but each holds a 256th of all fingerprints: at
256,410 of them their 2,048 lists make some 10^9 pairs to tally, four times as many at twice the size.

Equal fingerprints are one node.  A list with more than `list_rows` nodes is dealt to several
tasks as pairs of its parts, so no task holds it whole, and a task passes on a spanning forest
of its links, not all pairs.  Postings meet the sizes of their lists in a plain join, whose hot
keys Spark splits by measured size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, slices, text_column
from .components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LANES = np.uint64(0x0101010101010101)
SEED = 42


def words_of(text: bytes) -> list[bytes]:
    """Words between spaces, tabs and line ends, with A-Z in lower case."""
    return text.translate(_LOWER).split()


def shingle_hashes(words: list[bytes], width: int = 3) -> np.ndarray:
    """XXH64 of every run of `width` words (of all of them, if fewer), repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it."""
    n, out = len(hashes), 0
    if not n:
        return 0
    groups = np.arange(0, n, 255)  # so many bytes can be added in a byte
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, groups)
        counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        for lane in np.flatnonzero(2 * counts > n):
            out |= 1 << (8 * int(lane) + bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) with fp the fingerprint as a signed long; texts without words have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, at = as_bytes(part.column(1))
                raw = raw.tobytes()
                found = [fingerprint(shingle_hashes(words_of(raw[at[i] : at[i + 1]]), width)) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["id", "fp"])

    source = docs.select(docs[id_col].alias("id"), text_column(docs, text_col))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def blocks() -> list[tuple[int, ...]]:
    """The 14 quadruples of 8 places such that any 5 places hold one: zero sums in the group of 3-bit numbers under xor."""
    return [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def _postings(fp: Column) -> Column:
    byte = lambda p: F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long"))
    keys = []
    for k, places in enumerate(blocks()):
        key = F.lit(k).cast("long")
        for p in places:
            key = F.shiftleft(key, 8).bitwiseOR(byte(p))
        keys.append(key)
    return F.array(*keys)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that joins what the links a-b join: each node with the least of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Verified links between rows of a list; rows come sorted by list, and a list may go over several batches."""
    shared = 8 - bits
    held = None

    def out(lists: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left, step = np.arange(len(fp)), 1
        while len(left := left[left + step < len(fp)]) and len(left := left[lists[left] == lists[left + step]]):
            differ = fp[left] ^ fp[left + step]
            enough = (np.ascontiguousarray(differ).view(np.uint8).reshape(-1, 8) == 0).sum(1) >= shared  # counts of shared bytes
            good = left[enough][np.bitwise_count(differ[enough]) <= bits]  # verified bit by bit
            found_a.append(fp[good].view(np.int64))
            found_b.append(fp[good + step].view(np.int64))
            if sum(map(len, found_a)) > 1 << 20:
                a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b = [a], [b]
            step += 1
        a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        lists = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)], 1)
        lists = lists.astype(np.int64).view("i8,i8").ravel()
        fp = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        if held is not None:
            lists, fp = np.concatenate([held[0], lists]), np.concatenate([held[1], fp])
        last = int(np.argmax(lists == lists[-1])) if len(lists) else 0
        if last:
            yield out(lists[:last], fp[:last])
        held = lists[last:], fp[last:]
    if held is not None and len(held[0]) > 1:
        yield out(*held)


def links(nodes: DataFrame, bits: int = 3, list_rows: int = 1000) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints at `bits` or fewer differing bits."""
    if not 0 <= bits <= 3:
        raise ValueError("the index finds up to 3 differing bits")
    postings = nodes.select(F.explode(_postings(F.col("fp"))).alias("list"), "fp")
    sizes = postings.groupBy("list").agg(F.count("*").alias("n")).filter("n > 1").select("list", F.ceil(F.col("n") / list_rows).cast("long").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    dealt = postings.join(sizes, "list").select("list", "fp", "parts", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("list", (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("pair"), "fp")
    dealt = dealt.repartition("list", "pair").sortWithinPartitions("list", "pair", "fp")
    return dealt.mapInArrow(lambda batches: _links(batches, bits), "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3, width: int = 3, list_rows: int = 1000) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id that links reach.

    Null and empty texts have fingerprint 0 and are linked like others; repeated rows and ids have
    the same component; a component that only has null ids has a null component_id.  Very long texts
    count with all their shingles; other columns don't matter; an empty table gives none.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(nodes, bits, list_rows), "a", "b")
    joined = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    small = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    per_node = joined.join(small, "component").select("fp", "component_id")
    return prints.join(per_node, "fp").select("id", "fp", "component_id")


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart where ids may be null or repeated: ordered by id, null ids last, then by a digest of the text."""
    return F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("digest"))


def survivors(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False) -> DataFrame:
    """One document of each component of `found` (id, component_id), the one with the smallest id.

    Without `by_row` ids name documents: of rows that repeat an id, one stays.  With it `found` is
    about row keys (`row_key`): rows with a null or repeated id and different texts are different
    documents, and only those with the same id and text are one.
    """
    keep = cut(found.filter("id <=> component_id").select("id"))
    own = row_key(docs, id_col, text_col) if by_row else docs[id_col]
    ids = keep.distinct()
    kept = docs.join(ids, own == ids["id"] if by_row else own.eqNullSafe(ids["id"]), "left_semi")
    if keep.groupBy("id").count().filter("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates([id_col, text_col] if by_row else [id_col])


def report(docs: DataFrame) -> DataFrame:
    """The columns of query op9."""
    found = groups(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

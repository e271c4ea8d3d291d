"""Benchmark decontamination with suffix arrays over shards of the training text.

Each shard (a run of whole documents in one task) gets an array of its word suffixes in
lexicographic order.  Every different window of the test items is looked up there by binary
search: its bounds are all places where it occurs verbatim.  Places on one diagonal (document
position minus item position) that follow one another are one longest match.

Only suffixes that begin like some test suffix are entered in the array: a suffix whose first four
words never follow one another in a test item can't match a longer window (items of fewer words
have tables of their own).  Windows are looked up once, however many items share them, and lead to
their items only after a document's windows are known.  Test items are taken in blocks of bounded
size; each block is broadcast, and what further blocks hit is joined to the documents, so neither
side has to fit into memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, as_bytes, inner_text, slices, text_column

#: Words of test items in one broadcast block at most (an item alone may be longer).
BLOCK_WORDS = 2_000_000
_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z only) of digits, letters a-z and characters beyond ASCII."""
    return text.translate(ALNUM).split()


def _slots(rows: np.ndarray) -> np.ndarray:
    """A slot of the seed table for each row of word numbers."""
    key = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        key = key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j].astype(np.uint64)
    return (key * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _BITS)


def _seed(ids: np.ndarray, width: int) -> np.ndarray:
    """Slots of the `width` words from each position on."""
    return _slots(np.lib.stride_tricks.sliding_window_view(ids, width))


def _expand(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of n places from begin: which range, and which place, one after another."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(which))


@dataclass
class TestSuffixes:
    """The different windows of a block of test items in order, and the (item, place) pairs of each from `first` on."""

    __test__ = False

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    names: list = field(default_factory=list)
    low: np.ndarray = None
    high: np.ndarray = None
    span: np.ndarray = None
    first: np.ndarray = None
    item: np.ndarray = None
    start: np.ndarray = None
    seeds: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[tuple[object, bytes]], window: int) -> TestSuffixes:
        t = cls(window)
        keys, item, start = [np.zeros((0, window), ">u4")], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, text in items:
            if not (ids := [t.vocabulary.setdefault(w, len(t.vocabulary) + 1) for w in words_of(text)]):
                continue
            ids = np.array(ids, np.uint32)
            width, seed = min(window, len(ids)), min(4, window, len(ids))
            n = len(ids) - width + 1
            padded = np.zeros((n, window), ">u4")
            padded[:, :width] = np.lib.stride_tricks.sliding_window_view(ids, width)
            keys.append(padded)
            item.append(np.full(n, len(t.names), np.int64))
            start.append(np.arange(n, dtype=np.int64))
            t.names.append(name)
            t.seeds.setdefault(seed, np.zeros(1 << _BITS, bool))[_seed(ids, seed)] = True
        text = lambda x: np.ascontiguousarray(x.astype(">u4")).view(f"S{4 * window}").ravel()
        every = np.concatenate(keys)
        t.low, one, which = np.unique(text(every), return_index=True, return_inverse=True)
        different = every[one].reshape(-1, window)
        t.span = (different > 0).sum(1).astype(np.int64)
        t.high = text(np.where(different > 0, different, 0xFFFFFFFF))
        order = np.argsort(which, kind="stable")
        t.item, t.start = np.concatenate(item)[order], np.concatenate(start)[order]
        t.first = np.searchsorted(which[order], np.arange(len(t.low) + 1))
        return t

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence in a shard's words; 0 stands for words that no item has."""
        at = [np.zeros(0, np.int64)]
        for seed, table in self.seeds.items():
            if len(ids) >= seed:
                known = np.lib.stride_tricks.sliding_window_view(ids > 0, seed).all(1)
                near = np.flatnonzero(known)
                at.append(near[table[_slots(ids[near[:, None] + np.arange(seed)])]])
        at = np.unique(np.concatenate(at))
        padded = np.concatenate([ids, np.zeros(self.window, ids.dtype)])
        suffixes = np.ascontiguousarray(padded[at[:, None] + np.arange(self.window)].astype(">u4")).view(f"S{4 * self.window}").ravel()
        order = np.argsort(suffixes, kind="stable")
        suffixes, at = suffixes[order], at[order]
        lo, hi = np.searchsorted(suffixes, self.low, "left"), np.searchsorted(suffixes, self.high, "right")
        which, place = _expand(lo, hi - lo)
        return which, at[place]

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        """The items that have one of these windows."""
        n = self.first[windows + 1] - self.first[windows]
        return np.unique(self.item[_expand(self.first[windows], n)[1]])


def _shard(batch: pa.RecordBatch, tests: TestSuffixes, text: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per document, first word of each document in the shard, and window, document and place of each occurrence."""
    raw, at = as_bytes(batch.column(batch.schema.get_field_index("text")) if text is None else inner_text(batch, text))
    raw, get = raw.tobytes(), tests.vocabulary.get
    counts, parts = np.zeros(batch.num_rows, np.int64), []
    for i in range(batch.num_rows):
        found = words_of(raw[at[i] : at[i + 1]])
        counts[i] = len(found)
        found.append(b"")
        parts.append(np.array([get(w, 0) for w in found], np.uint32))  # the last is 0: no match crosses documents
    first = np.concatenate([[0], np.cumsum(counts + 1)])
    which, place = tests.places(np.concatenate(parts) if parts else np.zeros(0, np.uint32))
    doc = np.searchsorted(first, place, "right") - 1
    return counts, first, which, doc, place


def joined(a: list[int], b: list[int]) -> list[int]:
    """The runs of two lists of starts and ends, with those that overlap or touch as one."""
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _judged(part: pa.RecordBatch, tests: TestSuffixes, text: str | None) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """Words, runs of hit words and sorted items of each row."""
    counts, first, which, doc, place = _shard(part, tests, text)
    spans, names = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
    order = np.lexsort((place, doc))
    which, doc, place = which[order], doc[order], place[order]
    bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
    for i in np.unique(doc):
        lo, hi = bounds[i], bounds[i + 1]
        begin = place[lo:hi] - first[i]
        end = np.maximum.accumulate(begin + tests.span[which[lo:hi]])
        new = np.concatenate([[True], begin[1:] > end[:-1]])
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(begin) - 1]])
        spans[i] = np.stack([begin[new], end[last]], 1).ravel().tolist()
        names[i] = sorted({str(tests.names[k]) for k in tests.items_of(np.unique(which[lo:hi]))})
    return counts, spans, names


def _scan(batches: Iterator[pa.RecordBatch], tests: TestSuffixes, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text, inner=True):
            counts, spans, names = _judged(part, tests, text)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], names=["row", "n_words", "hit_spans", "items"])


def _found(batches: Iterator[pa.RecordBatch], tests: TestSuffixes) -> Iterator[pa.RecordBatch]:
    """(one, two, spans, names) of the texts that a further block hits."""
    for batch in batches:
        for part in slices(batch):
            _, spans, names = _judged(part, tests, None)
            hit = [i for i, x in enumerate(spans) if x]
            at = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array([spans[i] for i in hit], pa.list_(pa.int64())), pa.array([names[i] for i in hit], pa.list_(pa.string()))], names=["one", "two", "spans", "names"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, n_words, hit_spans, items, more), where more is null or has the spans and names of other blocks."""
    for batch in batches:
        spans, names = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for i in np.flatnonzero(batch.column(4).is_valid().to_numpy(zero_copy_only=False)).tolist():
            for other in batch.column(4)[i].as_py():
                spans[i], names[i] = joined(spans[i], other["spans"]), sorted({*names[i], *other["names"]})
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], names=["row", "n_words", "hit_spans", "items"])


def blocks(tests: DataFrame, id_col: str, text_col: str, window: int, block_words: int = BLOCK_WORDS) -> Iterator[TestSuffixes]:
    """The test items in blocks of about `block_words` words; only one block is held at a time."""
    items = tests.select(tests[id_col].alias("item"), text_column(tests, text_col)).filter("item IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (6 * block_words)))
    for k in range(n):
        rows = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield TestSuffixes.build([(r.item, r.text.encode()) for r in rows.toLocalIterator()], window)


def matches(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Longest verbatim matches: `id_col`, item, doc_word, item_word, n_words.

    A row is a maximal run of equal words of at least `window` words (of the whole item where it
    is shorter).  Null ids of items are left out; a null text has no words; very long texts are
    searched whole; repeated rows have rows each, and so has each of several items that share a match.
    Other columns, whatever their names, don't matter; an empty table of documents or of items gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("id"), text_column(docs, text_col))
    out = None
    for block in blocks(tests, item_col, item_text_col, window, block_words):
        shared = spark.sparkContext.broadcast(block)

        def find(batches, shared=shared):
            t = shared.value
            for batch in batches:
                for part in slices(batch):
                    _, first, which, doc, place = _shard(part, t)
                    pair, each = _expand(t.first[which], t.first[which + 1] - t.first[which])
                    doc, place, span = doc[pair], place[pair], t.span[which[pair]]
                    begin, item, start = place - first[doc], t.item[each], t.start[each]
                    order = np.lexsort((begin, begin - start, item, doc))
                    doc, begin, item, start, span = (x[order] for x in (doc, begin, item, start, span))
                    new = np.ones(len(doc), bool)
                    if len(doc):
                        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | ((begin - start)[1:] != (begin - start)[:-1]) | (begin[1:] != begin[:-1] + 1)
                    head = np.flatnonzero(new)
                    tail = np.concatenate([head[1:], [len(doc)]]) - 1 if len(head) else head
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(doc[head])), pa.array([str(t.names[k]) for k in item[head]], pa.string()), pa.array(begin[head]), pa.array(start[head]), pa.array(begin[tail] + span[tail] - begin[head])],
                        names=["id", "item", "doc_word", "item_word", "n_words"],
                    )

        kind = source.schema["id"].dataType.simpleString()
        found = source.mapInArrow(find, f"id {kind}, item string, doc_word long, item_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def hits(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document with the words inside any occurrence of a test window.

    Returns all columns of docs and n_words, hit_spans (start, end, start, end ... of the runs of
    hit words), items (ids of matched items as sorted strings).  Columns of docs with those names
    are replaced.  A null or empty text has no words; very long texts are searched whole; repeated
    rows are judged alike; test items with a null id or no words are left out; with equal ids (ties)
    all their windows count as one item's.  An empty table gives none.

    The first block of test items is scanned without a shuffle.  What further blocks hit is met by
    the documents through two hashes of their text.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("n_words", "hit_spans", "items")]
    row = F.struct(*[docs[c] for c in kept]).alias("row")
    shape = f"row {docs.select(row).schema['row'].dataType.simpleString()}, n_words long, hit_spans array<long>, items array<string>"
    text = text_column(docs, text_col)
    keys = docs.select(text).select(F.xxhash64("text").alias("one"), F.xxhash64(F.lit(5), "text").alias("two"), "text")
    found, more = None, []
    for block in blocks(tests, item_col, item_text_col, window, block_words):
        shared = spark.sparkContext.broadcast(block)
        if found is None:
            found = docs.select(row).mapInArrow(lambda batches, shared=shared: _scan(batches, shared.value, text_col), shape)
        else:
            own = keys.mapInArrow(lambda batches, shared=shared: _found(batches, shared.value), "one long, two long, spans array<long>, names array<string>")
            # copies of a text are hit alike
            more.append(own.groupBy("one", "two").agg(F.first(F.struct("spans", "names")).alias("hit")))
    if more:
        every = reduce(DataFrame.unionByName, more).groupBy("one", "two").agg(F.collect_list("hit").alias("more"))
        own = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
        met = found.join(every, (F.xxhash64(own) == F.col("one")) & (F.xxhash64(F.lit(5), own) == F.col("two")), "left")
        found = met.select("row", "n_words", "hit_spans", "items", "more").mapInArrow(_merged, shape)
    return found.select("row.*", "n_words", "hit_spans", "items")


def n_hit(spans: str = "hit_spans"):
    """Number of hit words from the runs."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def clean(docs: DataFrame, tests: DataFrame, **how) -> DataFrame:
    """The documents without any hit, with their own columns."""
    return hits(docs, tests, **how).filter(F.size("hit_spans") == 0).select(*docs.columns)


def report(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The digest columns of query op5: one row per document."""
    found = hits(docs.select("doc_id", "text"), tests)
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )

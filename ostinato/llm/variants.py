"""Groups of spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

One edit leaves a half of a word as it was.  So two words that near share their first half or their
second one, and meet in a block of the dictionary sorted by first halves, or of the one sorted from
the end.  Blocks are scanned in order and their words compared; a block of more than `MOST` words is
subdivided first: what its words don't share yet is halved again, until at last one position is left
open, where an alphabet bounds the block.  Words of one length and words of two lengths have blocks of
their own, and a pair counts only in the one block whose range holds its first difference.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, dropped, exact_words, mixed, padded, slices, text_column, word_bounds, written

#: Words of a block that are compared with each other; larger blocks are subdivided.
MOST = 128
LEAST_CHARS, LEAST_COUNT = 5, 3
#: Runs with a crc32 divisible by this lose a letter (0: none do).
DAMAGE = 97
_SHORT = 32
_AT_ONCE = 1 << 19

#: Letters are A-Z, a-z and all characters whose UTF-8 begins with C3 (U+00C0 to U+00FF); the rest are spaces.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LEAD = 0xC3

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> np.uint32(1)), _CRC >> np.uint32(1)).astype(np.uint32)


def runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes (other characters are spaces), and start, end and row of each run of letters."""
    text = _LETTERS[raw]
    lead = np.flatnonzero(raw == _LEAD)
    text[lead], text[lead + 1] = _LEAD, raw[lead + 1]
    return text, *word_bounds(text, at)


def checksums(text: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The crc32 of each stretch after bytes whose crc32 is `first`, byte by byte for all at once."""
    state, size = first.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), end - start
    order = np.argsort(size, kind="stable")
    ends = np.searchsorted(size[order], np.arange(_SHORT + 1), "right")
    for k in range(_SHORT):
        left = order[ends[k] :]
        if not len(left):
            break
        own = state[left]
        state[left] = _CRC[(own ^ text[start[left] + k]) & np.uint32(255)] ^ (own >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for k in order[ends[_SHORT] :].tolist():
        state[k] = zlib.crc32(text[start[k] + _SHORT : end[k]].tobytes(), int(state[k]))
    return state


def _tally(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different word of up to `_SHORT` bytes stands first, and how often it occurs."""
    words = exact_words(padded(text, _SHORT), start, end, _SHORT)
    _, first, which, n = np.unique(mixed(words), return_index=True, return_inverse=True, return_counts=True)
    if not (words[first[which]] == words).all():  # two words with one hash
        _, first, n = np.unique(np.ascontiguousarray(words).view(f"V{8 * words.shape[1]}").ravel(), return_index=True, return_counts=True)
    return first, n


def _taken(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Stretches of UTF-8 as an Arrow column."""
    size = end - start
    ends = np.cumsum(size)
    flat = text[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): the different runs of letters of all whole texts, and how often each occurs.

    A run is lower-cased (A-Z only); where `damage` divides the crc32 of `id:run`, it loses the letter
    that the checksum names.  Null texts have no runs, a null id is empty; repeated rows count each.
    A very long text is read in parts of its runs; other columns don't matter; an empty table has no words.
    """
    source = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), text_column(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                text, start, end, row = runs(*as_bytes(part.column(1)))
                before = np.array([zlib.crc32(f"{x}:".encode()) for x in part.column(0).to_pylist()], np.uint32)
                leads = np.cumsum(text == _LEAD, dtype=np.int32)
                for k in range(0, len(start), _AT_ONCE):
                    s, e, r = start[k : k + _AT_ONCE], end[k : k + _AT_ONCE], row[k : k + _AT_ONCE]
                    chars = e - s - (leads[e - 1] - leads[s] + (text[s] == _LEAD))
                    few = Counter()
                    intact = chars >= least_chars
                    if damage:
                        h = checksums(text, s, e, before[r])
                        hit = np.flatnonzero((h % np.uint32(damage) == 0) & (chars > least_chars))
                        intact &= h % np.uint32(damage) != 0
                        for i in hit.tolist():
                            own = text[s[i] : e[i]].tobytes().decode()
                            gone = int(h[i]) % len(own)
                            few[own[:gone] + own[gone + 1 :]] += 1
                    long = np.flatnonzero(intact & (e - s > _SHORT))
                    few.update(text[s[i] : e[i]].tobytes().decode() for i in long.tolist())
                    short = np.flatnonzero(intact & (e - s <= _SHORT))
                    first, n = _tally(text, s[short], e[short]) if len(short) else (short, short)
                    yield pa.RecordBatch.from_arrays([_taken(text, s[short][first], e[short][first]), pa.array(n, pa.int64())], names=["word", "n"])
                    if few:
                        yield pa.RecordBatch.from_arrays([pa.array(list(few), pa.string()), pa.array(list(few.values()), pa.int64())], names=["word", "n"])

    return source.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


_KEY = ["two", "m", "lo", "hi", "head"]


def _part(two: Column, m: Column, lo: Column, hi: Column) -> Column:
    """The part of a block that a word stands in if its first difference from another lies in [lo, hi].

    `two`: pairs of words of m and m + 1 letters, else both have m.  The head is what such words share: `lo`
    letters in front, and those behind the difference, from the end.
    """
    behind = m - hi - F.when(two, 0).otherwise(1)
    return F.struct(two.alias("two"), m.cast("int").alias("m"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.concat(F.substr("word", F.lit(1), lo.cast("int")), F.lit("|"), F.reverse(F.right(F.col("word"), behind.cast("int")))).alias("head"))


def _halves(two: Column, m: Column, lo: Column, hi: Column) -> list[Column]:
    middle = F.floor((lo + hi + 1) / 2)
    return [_part(two, m, lo, middle - 1), _part(two, m, middle, hi)]


def _blocks(vocabulary: DataFrame) -> DataFrame:
    """Each word in the two halves of its length, of its length and the next, and of the one before and its own."""
    size, zero = F.length("word"), F.lit(0)
    parts = [*_halves(F.lit(False), size, zero, size - 1), *_halves(F.lit(True), size, zero, size), *_halves(F.lit(True), size - 1, zero, size - 1)]
    return vocabulary.select("word", "n", F.explode(F.array(*parts)).alias("b")).select("b.*", "word", "n")


def _subdivided(rows: DataFrame) -> DataFrame:
    return rows.select("word", "n", F.explode(F.array(*_halves(*(F.col(c) for c in _KEY[:4])))).alias("b")).select("b.*", "word", "n")


def one_edit(letters: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, m: int, two: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether the words of rows i and j are one edit apart, and where they first differ; with `two`, i has m letters and j one more."""
    a, b = letters[i], letters[j]
    if not two:
        unlike = a[:, :m] != b[:, :m]
        return unlike.sum(1) == 1, unlike.argmax(1)
    ahead, behind = a[:, :m] != b[:, :m], a[:, :m] != b[:, 1 : m + 1]
    place = np.where(ahead.any(1), ahead.argmax(1), m)
    last = np.where(behind.any(1), m - behind[:, ::-1].argmax(1), 0)  # one behind the last difference
    return last <= place, place


def _compared(two: bool, m: int, block: np.ndarray, lo: np.ndarray, hi: np.ndarray, letters: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows one edit apart inside the blocks, which stand one after another."""
    rows = np.arange(len(block))
    for apart in range(1, len(block)):
        i = rows[:-apart][block[apart:] == block[:-apart]]
        if not len(i):
            return
        j = i + apart
        if two:
            unlike = size[i] != size[j]
            i, j = i[unlike], j[unlike]
            i, j = np.where(size[i] == m, i, j), np.where(size[i] == m, j, i)
        step = max(1, (1 << 22) // (m + 1))
        for k in range(0, len(i), step):
            a, b = i[k : k + step], j[k : k + step]
            near, place = one_edit(letters, size, a, b, m, two)
            near &= (place >= lo[a]) & (place <= hi[a])
            yield a[near], b[near]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, other, other_n) both ways of all near words in sorted blocks; only the last block waits for the next batch."""
    left: pa.Table | None = None

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        keys = [table.column(c) for c in _KEY]
        new = np.ones(table.num_rows, bool)
        same = np.ones(table.num_rows - 1, bool)
        for key in keys:
            same &= np.asarray(pc.equal(key.slice(1), key.slice(0, table.num_rows - 1)))
        new[1:] = ~same
        block = np.cumsum(new)
        two, m, lo, hi = (np.asarray(k) for k in keys[:4])
        kinds = np.flatnonzero(np.concatenate([[True], (two[1:] != two[:-1]) | (m[1:] != m[:-1])]))
        for a, b in zip(kinds, [*kinds[1:], len(m)], strict=True):
            own = table.slice(a, b - a)
            raw, at = as_bytes(own.column("word"))
            lead = raw == _LEAD
            flat = np.where(np.concatenate([[False], lead[:-1]]), raw + np.uint8(64), raw)[~lead]  # a byte for each letter
            size = np.asarray(pc.utf8_length(own.column("word")))
            starts = np.cumsum(size) - size
            letters = np.zeros((len(size), int(m[a]) + 1), np.uint8)
            letters[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(starts, size)] = flat
            for i, j in _compared(bool(two[a]), int(m[a]), block[a:b], lo[a:b], hi[a:b], letters, size):
                if len(i):
                    word, n = own.column("word").combine_chunks(), own.column("n").combine_chunks()
                    i, j = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
                    yield from pa.table([word.take(i), word.take(j), n.take(j)], names=["word", "other", "other_n"]).to_batches(65_536)

    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if left is None else pa.concat_tables([left, now])
        last = {c: now.column(c)[-1] for c in _KEY}
        at = now.num_rows - 1
        while at and all(now.column(c)[at - 1] == last[c] for c in _KEY):
            at -= 1
        left = now.slice(at)
        if at:
            yield from done(now.slice(0, at))
    if left is not None:
        yield from done(left)


def near(vocabulary: DataFrame, most: int = MOST, made: list[str] | None = None) -> DataFrame:
    """(word, other, other_n) of all different words that are one inserted, deleted or replaced letter apart, both ways.

    `vocabulary` is (word, n) with a row per word of letters.  Each round writes the blocks, counts
    their words and subdivides those above `most`; rounds are logarithmic in the length of words.
    The folders of the result are added to `made`.
    """
    spark, found, paths = vocabulary.sparkSession, None, []
    rows = written(_blocks(vocabulary), paths)
    while True:
        heavy = written(rows.filter("lo < hi").groupBy(*_KEY).agg(F.count("*").alias("k")).filter(F.col("k") > most).drop("k"), paths)
        last = heavy.isEmpty()
        ready = rows if last else rows.join(heavy, _KEY, "left_anti")
        pairs = ready.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY, "word").select(*_KEY, "word", "n").mapInArrow(_scan, "word string, other string, other_n bigint")
        pairs = written(pairs, made)
        found = pairs if found is None else found.unionByName(pairs)
        now: list[str] = []
        if not last:
            rows = written(_subdivided(rows.join(heavy, _KEY, "left_semi")), now)
        dropped(spark, paths)
        if last:
            return found
        paths = now


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of (word, form) lead in the end, by doubling the way in each round."""
    paths: list[str] = []
    now = written(forms.select("word", F.col("form").alias("root")), paths)
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further: list[str] = []
        step = written(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), further)
        dropped(forms.sparkSession, paths)
        now, paths = step.select("word", "root"), further
        if step.filter("moved").isEmpty():
            return now


def variants(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n).

    A word's form is its near word of largest n (ties: the first in code-point order), if that is at
    least twice the word's own; forms lead to the root, which is the word itself if it has none.
    A form has at least twice the count, so that no way leads back.  An empty vocabulary gives no rows.
    """
    own: list[str] = []
    vocabulary = written(vocabulary.select("word", "n"), own)
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other")))
    met = vocabulary.join(near(vocabulary, most, own).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "word", "left")
    enough = -F.col("best.m") >= 2 * F.col("n")
    met = written(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")))
    dropped(met.sparkSession, own)
    roots = rooted(met.filter("form IS NOT NULL"))
    return met.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def report(docs: DataFrame) -> DataFrame:
    """The columns of query op12."""
    return variants(words(docs.select("doc_id", "text"))).select("word", "form", "root", "n", "n_near", "form_n")

"""Packing documents into token sequences: dominance reduction, then best fit.

Only the number of pieces of each length matters for packing, and lengths are 1 to the
capacity.  The plan is therefore made from a histogram with at most `capacity` rows, however
large the corpus is: lists of (pattern, number of sequences with it).  Martello and Toth's
dominance rule first fixes the sets that some best packing holds, then the rest is packed best
fit, longest first, many equal sequences at a time.  Spark deals the places of the plan to the
pieces: those of one length are numbered in salted groups of bounded size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordTable, as_bytes, cut, slices, text_column

CAPACITY = 2048
#: Pieces of one length that one task numbers, about.
GROUP_ROWS = 2000


_SPACE = b" \t\n\r\v\f"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space 0, ASCII letters and digits 1, other ASCII signs but ' 2, the rest 3.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[33:127] = 2
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_CLASS[ord("'")] = 3
_CLASS[list(_SPACE)] = 0


class WordTokenizer(WordTable):
    """Ids of whole texts from a lower-casing tokenizer that never joins text over white space, or letters with signs.

    Texts are cut into words there, and a `WordTable` keeps their ids for as long as the worker lives.
    """

    def __init__(self, path: str, limit: int = 1_200_000):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.inner.get_added_tokens_decoder().values()]
        super().__init__(lambda words: [e.ids for e in self.inner.encode_batch(words, add_special_tokens=False)], limit)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the n + 1 bounds."""
        kind = _CLASS[raw]
        new = np.zeros(len(raw) + 1, bool)  # a word may begin here
        new[at] = True
        if len(raw) > 1:
            letter = kind[:-1] == 1
            latin = (raw[1:-1] >= 0x80) & (raw[1:-1] != 0x97) & (raw[1:-1] != 0xB7) & (raw[:-2] == 0xC3)
            letter[1:] |= latin
            new[1:-1] |= (letter & (kind[1:] == 2)) | ((kind[:-1] == 2) & (kind[1:] == 1))
        inside = np.concatenate([[False], kind > 0, [False]])
        start = np.flatnonzero(inside[1:-1] & (new[:-1] | ~inside[:-2]))
        end = np.flatnonzero(inside[1:-1] & (new[1:] | ~inside[2:])) + 1
        ids, sizes = self.look_up(_LOWER[raw], raw.tobytes(), start, end)
        total = np.concatenate([[0], sizes.cumsum()])
        return ids, total[np.searchsorted(start, at)]

    def texts(self, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each row; a text that spells out a special token goes to the tokenizer whole, which gives it that token's id."""
        ids, bounds = self.encode(raw, at)
        out = [ids[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        flat = raw.tobytes()
        for token in self.special:
            place = flat.find(token)
            while place >= 0:
                i = int(np.searchsorted(at, place, "right")) - 1
                out[i] = np.array(self.inner.encode(flat[at[i] : at[i + 1]].decode(errors="ignore"), add_special_tokens=False).ids, np.uint32)
                place = flat.find(token, max(int(at[i + 1]), place + 1) if place + len(token) <= at[i + 1] else place + 1)
        return out


@cache
def tokenizer_of(path: str) -> WordTokenizer:
    """One for each Python worker: the words it knows serve later tasks too."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document: its ids and `end_id`, cut after each `capacity` ids."""
    source = docs.select(docs[id_col].alias("id"), text_column(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = tokenizer_of(tokenizer)
        for batch in batches:
            for part in slices(batch, limit=1 << 19):
                rows, starts, lengths, crcs = [], [], [], []
                for i, ids in enumerate(words.texts(*as_bytes(part.column(1)))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), capacity):
                        own = ids[at : at + capacity]
                        rows.append(i)
                        starts.append(at)
                        lengths.append(len(own))
                        crcs.append(zlib.crc32(own.tobytes()))
                start = np.array(starts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array((start // capacity).astype(np.int32)), pa.array(start), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """Sets that some best packing holds, fixed for good, and the pieces that are left.

    For a piece x take the longest other piece y that fits beside it.  {x} dominates if none fits,
    {x, y} if they fill the sequence, if no two other pieces fit beside x, or if no three fit and y is
    as long as the best two: whatever shares a sequence with x in a best packing can then change
    places with y.
    """
    left = Counter({s: n for s, n in counts.items() if n > 0})
    fixed: Plan = []
    changed = True
    while changed:
        changed = False
        for x in sorted(left, reverse=True):
            while left[x] > 0:
                other = sorted(s for s, n in left.items() if n - (s == x) > 0)
                room = capacity - x
                fits = [s for s in other if s <= room]
                if not fits:
                    fixed.append((((x, 1),), left[x]))
                    left[x] = 0
                    changed = True
                    break
                y = fits[-1]
                if y < room and (y < _best_pair(fits, left, x, room) or _three_fit(fits, left, x, room)):
                    break
                n = left[x] // 2 if x == y else min(left[x], left[y])  # taking pieces only takes alternatives away
                fixed.append((((x, 2),) if x == y else ((x, 1), (y, 1)), n))
                left[x] -= n
                left[y] -= n
                changed = True
        left = Counter({s: n for s, n in left.items() if n > 0})
    return fixed, dict(left)


def _best_pair(fits: list[int], left: Counter, x: int, room: int) -> int:
    """The most that two pieces beside x can fill, 0 if no two fit."""
    best, hi = 0, len(fits) - 1
    for lo, a in enumerate(fits):
        while hi >= lo and (a + fits[hi] > room or (hi == lo and left[a] - (a == x) < 2)):
            hi -= 1
        if hi < lo:
            break
        best = max(best, a + fits[hi])
    return best


def _three_fit(fits: list[int], left: Counter, x: int, room: int) -> bool:
    """True if the three shortest pieces beside x fit."""
    short = [s for s in fits[:3] for _ in range(min(3, left[s] - (s == x)))][:3]
    return len(short) == 3 and sum(short) <= room


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest first, for so many pieces of each length."""
    open_: dict[int, list[list]] = {}
    for size in sorted(counts, reverse=True):
        n = counts[size]
        for room in sorted(r for r in open_ if r >= size):
            while n and open_.get(room):
                pattern, times = open_[room].pop()
                each = min(room // size, n)  # the room left is the tightest then, so the next piece goes there too
                full = min(times, n // each)
                if times > full:
                    open_[room].append([pattern, times - full])
                open_.setdefault(room - each * size, []).append([(*pattern, (size, each)), full])
                n -= full * each
            if not open_[room]:
                del open_[room]
        each = capacity // size
        if full := n // each:
            open_.setdefault(capacity - each * size, []).append([((size, each),), full])
            n -= full * each
        if n:
            open_.setdefault(capacity - n * size, []).append([((size, n),), 1])
    return [(pattern, times) for group in open_.values() for pattern, times in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Patterns of (length, number) pairs, and how many sequences have each."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """The place of the k-th piece of each length."""

    def __init__(self, sequences: Plan):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        filled: Counter = Counter()
        first = 0
        for pattern, times in sequences:
            at = 0
            for size, each in pattern:
                rows.setdefault(size, []).append((filled[size], first, each, at))
                filled[size] += each * times
                at += each * size
            first += times
        self.rows = {size: np.array(x, np.int64).T for size, x in rows.items()}

    def of(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces of a length by their numbers from 0."""
        begin, first, each, at = self.rows[size]
        k = np.searchsorted(begin, rank, "right") - 1
        step = rank - begin[k]
        return first[k] + step // each[k], at[k] + step % each[k] * size


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Every document has at least one piece, as `end_id` follows its ids (null and empty texts have
    just that).  Rows that repeat an id are documents of their own.  A very long text is cut into as many pieces
    as it needs, and only such texts are; documents of equal length take places in the order of their hashes.
    Other columns of docs, whatever their names, don't matter.  An empty table has no rows.
    """
    spark = docs.sparkSession
    cutting = cut(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    # at most `capacity` rows, whatever the size of the corpus
    counts = {r.length: r.n for r in cutting.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan(counts, capacity)))
    # a row per length
    parts = spark.createDataFrame([(s, max(1, -(-n // group_rows))) for s, n in counts.items()], "length long, parts long")
    salted = cutting.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("parts")))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "salt", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("number", number).join(sizes, ["length", "salt"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = places.value.of
        for batch in batches:
            size, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                own = size == s
                sequence[own], offset[own] = of(int(s), rank[own])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cutting.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def vocabulary() -> str:
    """The public vocabulary of query op4."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def report(docs: DataFrame) -> DataFrame:
    """The columns of query op4."""
    return pack(docs.select("doc_id", "text"), vocabulary())

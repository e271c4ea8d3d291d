"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Offsets into a batch of texts stay below this many bytes, whatever the batch holds.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (local runs)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ostinato-"))
        found = sc.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once and read it from there, so that lost executors don't repeat its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it from there; smaller on disk than a checkpoint.

    The folder is added to `paths`, for `dropped` once nothing reads it any more.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that `written` made, and empty the list; what is still read must have been written elsewhere."""
    sc = spark.sparkContext
    while paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def text_column(df: DataFrame, text_col: str, alias: str = "text"):
    """The text as a string column in which null is empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit("")).alias(alias)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column without nulls, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def inner_text(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The texts inside the rows of a struct column, which comes first; null is empty."""
    column = batch.column(0).field(name)
    return (column if pa.types.is_string(column.type) else column.cast(pa.string())).fill_null("")


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES, inner: bool = False) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about `limit` bytes of text (a longer row stands alone); inner: the text is in a struct column."""
    n = batch.num_rows
    if not n:
        return
    _, at = as_bytes(inner_text(batch, text) if inner else batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def translation(keep: bytes) -> bytes:
    """For bytes.translate: A-Z in lower case, `keep` and all bytes of non-ASCII letters stay, the rest become spaces."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in keep:
        table[c] = c
    for c in range(65, 91):
        table[c] = c + 32
    return bytes(table)


#: Words of digits, a-z and any character beyond ASCII.
ALNUM = translation(b"0123456789abcdefghijklmnopqrstuvwxyz")


class Rolling:
    """64-bit hashes of any stretch of a byte array, from sums of random codes times powers of an odd number."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 11):
        self.codes = np.random.default_rng(seed).integers(1, 1 << 64, 256, np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, raw: np.ndarray) -> np.ndarray:
        """Sums up to each position; for `of`."""
        n = len(raw) + 1
        if n > len(self.up):
            size = 1 << n.bit_length()
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.multiply.accumulate(np.full(size, self.BASE, np.uint64))])
            self.down = np.concatenate([one, np.multiply.accumulate(np.full(size, pow(self.BASE, -1, 1 << 64), np.uint64))])
        sums = np.zeros(n, np.uint64)
        np.cumsum(self.codes[raw] * self.up[: n - 1], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of the stretches [start, end)."""
        x = (sums[end] - sums[start]) * self.down[start]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(32))


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def padded(raw: np.ndarray, most: int) -> np.ndarray:
    """The bytes with zeros behind them, so that `most` bytes can be read from any of them."""
    return np.concatenate([raw, np.zeros(most + 8, np.uint8)])


def eight(lower: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start as a number; `left` bytes count, none if it is negative."""
    every = np.ndarray(len(lower) - 7, "<u8", lower.data, strides=(1,))
    return every[start] & _MASKS[np.clip(left, 0, 8)]


def exact_words(lower: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """A row of numbers for each stretch of up to `most` bytes of `padded` ones: all its bytes and its length."""
    out = np.empty((len(start), most // 8 + 1), np.uint64)
    for k in range(most // 8):
        out[:, k] = eight(lower, start + 8 * k, end - start - 8 * k)
    out[:, -1] = end - start
    return out


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def mixed(words: np.ndarray, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each row of numbers, stirred after each of them."""
    h = np.full(len(words), seed, np.uint64)
    for k in range(words.shape[1] - 1, -1, -1):
        own = words[:, k]
        busy = slice(None) if k == words.shape[1] - 1 else np.flatnonzero(own)  # most rows are short
        h[busy] = _stir(h[busy] ^ (own[busy] * np.uint64(0x165667B19E3779F9 + 2 * k)))
    return h


def word_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 32) -> np.ndarray:
    """64-bit hashes of words, all bytes of each stirred in turn; those of more than `most` bytes by xxhash."""
    out, n = np.empty(len(start), np.uint64), end - start
    short, long = np.flatnonzero(n <= most), np.flatnonzero(n > most)
    out[short] = mixed(exact_words(padded(text, most), start[short], end[short], most))
    if len(long):
        flat = text.tobytes()
        out[long] = [xxhash.xxh3_64_intdigest(flat[a:b], 17) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def _distinct(words: np.ndarray) -> np.ndarray:
    """Where each different row stands first."""
    rows = np.ascontiguousarray(words).view(f"S{8 * words.shape[1]}").ravel()  # of one width, so zeros at the end count
    return np.unique(rows, return_index=True)[1]


class WordTable:
    """Token ids of words, for as long as it lives.

    Words of up to `LONG` bytes are kept, byte for byte; a hash only says where to look.  Only words
    not seen before, and all longer ones, reach `encode_words`.  When it is full it forgets all.
    """

    SLOTS = 1 << 22
    LONG = 32

    def __init__(self, encode_words: Callable[[list[str]], list[list[int]]], limit: int = 1_200_000):
        self.encode_words, self.limit = encode_words, limit
        self.reset()

    def reset(self) -> None:
        self.slots = np.full(self.SLOTS, -1, np.int32)
        self.words, self.at, self.n = np.zeros((1 << 15, self.LONG // 8 + 1), np.uint64), np.zeros(1 << 15, np.int64), 0
        self.ids = np.zeros(1 << 16, np.uint32)

    def _slot(self, words: np.ndarray) -> np.ndarray:
        return (mixed(words) >> np.uint64(42)).astype(np.int64)

    def _find(self, words: np.ndarray) -> np.ndarray:
        """The number of each word (its bytes and length), or -1."""
        found, slot = np.full(len(words), -1, np.int64), self._slot(words)
        left = np.arange(len(words))
        while len(left):
            row = self.slots[slot[left]]
            same = (row >= 0) & (self.words[row] == words[left]).all(1)
            found[left[same]] = row[same]
            left = left[~same & (row >= 0)]
            slot[left] = (slot[left] + 1) % self.SLOTS
        return found

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and how many each has."""
        found = self.encode_words(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _learn(self, fresh: np.ndarray, words: list[str]) -> None:
        """Enter words that aren't there."""
        ids, sizes = self._encoded(words)
        n, end = self.n + len(words), self.at[self.n] + sizes.cumsum()
        while n + 2 > len(self.at):
            self.at, self.words = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.words, np.zeros_like(self.words)])
        while end[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.at[self.n] : end[-1]] = ids
        self.at[self.n + 1 : n + 1] = end
        self.words[self.n : n] = fresh
        slot, left = self._slot(fresh), np.arange(len(words))
        while len(left):
            _, first = np.unique(slot[left], return_index=True)  # one word for each free slot
            first = first[self.slots[slot[left[first]]] < 0]
            self.slots[slot[left[first]]] = self.n + left[first]
            left = np.delete(left, first)
            slot[left] = (slot[left] + (self.slots[slot[left]] >= 0)) % self.SLOTS
        self.n = n

    def _rows(self, flat: bytes, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        rows = self._find(words)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            first = missing[_distinct(words[missing])]
            if self.n + len(first) > self.limit:
                self.reset()
                missing = np.arange(len(words))
                first = _distinct(words)
            self._learn(words[first], [flat[s:e].decode() for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            rows[missing] = self._find(words[missing])
        return rows

    def look_up(self, keys: np.ndarray, flat: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has; words are known by `keys` (bytes, or what they are the same as)."""
        keys, parts, sizes = padded(keys, self.LONG), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(start), 1 << 17):
            s, e = start[k : k + (1 << 17)], end[k : k + (1 << 17)]
            n, begin = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
            short = np.flatnonzero(e - s <= self.LONG)
            rows = self._rows(flat, exact_words(keys, s[short], e[short], self.LONG), s[short], e[short])
            n[short] = self.at[rows + 1] - self.at[rows]
            ids, begin[short] = self.ids, self.at[rows]
            if len(short) < len(s):
                long = np.flatnonzero(e - s > self.LONG)
                more, n[long] = self._encoded([flat[a:b].decode() for a, b in zip(s[long].tolist(), e[long].tolist(), strict=True)])
                ids, begin[long] = np.concatenate([ids, more]), len(ids) + n[long].cumsum() - n[long]
            ends = n.cumsum()
            parts.append(ids[np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]))])
            sizes.append(n)
        return np.concatenate(parts), np.concatenate(sizes)


def word_bounds(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words stand between spaces and never cross rows (at: the rows' bounds)."""
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = text != 32
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(text))]
    both = cuts[inside[cuts] & inside[cuts + 1]]  # a word ends where another row's word begins
    first[both], last[both - 1] = True, True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1

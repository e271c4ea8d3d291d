"""Exact removal of byte strings that occur again anywhere, by distributed prefix doubling.

Every window of `length` bytes is ranked by ever longer stretches until its rank is unique (it
can't occur again) or covers the whole window.  Naming each of all positions in each round would
shuffle many times the text, so positions share names as long as their context is the same:

1. A window is represented by its anchor, the least hashed `seed` bytes in it.  Equal windows have
   equal anchors, and neighbouring windows share one.  Spark ranks the anchors: an anchor that
   occurs once ends the matter for all its windows.
2. The second rank pairs the anchor's with the whole stretch of the windows that share it.
   A stretch that occurs again is past the length in all its windows: each is removed.
3. Where an anchor occurs again in different stretches, one copy of each stretch is sorted by
   rank, and its windows are ranked at growing offsets, without those that are unique.

Ranks are names of byte stretches, not dense numbers, so no round needs a global count: an anchor's
is a 64-bit rolling hash, a stretch's that and an xxhash of all its bytes, two unlike names that must
both be equal, and what windows of one anchor have in common is compared byte by byte.  A rank that very many different stretches share is spread over tasks, window by window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, as_bytes, slices, text_column, written

#: Different stretches of one anchor that a task compares; anchors with more are spread.
MOST_STRETCHES = 2000
#: Anchors with more stretches than that are at most so many; the limit above rises to keep to it.
MOST_HOT = 500_000
#: Places that a task remembers so as not to send them again for repeated rows.
MOST_SEEN = 500_000
#: Bits of the tables that tell which anchors a second look is worth; more rows only make it less choosy.
TABLE_BITS = 27
_BLOCK_BITS = 18
_WINDOWS = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def stretches(raw: np.ndarray, at: np.ndarray, length: int, seed: int, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """Row, start, number of windows, offset of the anchor, name of the anchor and name of the whole, of each stretch.

    A stretch is a run of windows of one row that have the same anchor; it covers number + length - 1 bytes.
    """
    sums, w = rolling.load(raw), length - seed + 1
    places = np.arange(max(len(raw) - seed + 1, 0))
    names = rolling.of(sums, places, places + seed)
    key = (names & ~_LOW) | places.astype(np.uint64)
    fill = np.full(-len(key) % w, ~np.uint64(0))
    table = np.concatenate([key, fill]).reshape(-1, w)
    left, right = np.minimum.accumulate(table, 1).ravel(), np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    sizes = np.maximum(np.diff(at) - length + 1, 0)
    row = np.repeat(np.arange(len(at) - 1), sizes)
    p = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + at[row]
    anchor = (np.minimum(right[p], left[p + w - 1]) & _LOW).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(p)))
    start, anchor, row = p[head], anchor[head], row[head]
    offset = anchor - start
    flat = raw.tobytes()
    whole = np.fromiter((xxhash.xxh3_64_intdigest(flat[s:e], k) for s, e, k in zip(start.tolist(), (start + n + length - 1).tolist(), (offset * 4096 + n).tolist(), strict=True)), np.uint64, len(start))
    return row, start - at[row], n, offset, names[anchor], whole


def parts_of(batch: pa.RecordBatch, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Slices of a batch as (rows, bytes, bounds, first byte in the row); a very long text comes in overlapping parts."""
    for part in slices(batch, limit=1 << 20):
        raw, at = as_bytes(part.column(part.schema.get_field_index("text")))
        if len(raw) <= 2 * _WINDOWS:
            yield part, raw, at, 0
            continue
        for i in range(part.num_rows):
            for lo in range(0, max(1, int(at[i + 1] - at[i]) - length + 1), _WINDOWS):
                piece = raw[at[i] + lo : min(at[i + 1], at[i] + lo + _WINDOWS + length - 1)]
                yield part.slice(i, 1), piece, np.array([0, len(piece)]), lo


def pack(start: np.ndarray, n: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 24) | (n << 12) | offset


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """A table of fixed size with a bit for each key, as bytes; built in blocks."""
    spots = keys.select(F.pmod(F.col(column), F.lit(1 << TABLE_BITS)).alias("spot")).distinct()
    blocks = spots.select(F.shiftright("spot", _BLOCK_BITS).alias("block"), F.col("spot").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).alias("bit"))

    def run(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _BLOCK_BITS, np.uint8)
        bits[group.column("bit").to_numpy()] = 1
        return pa.table({"block": group.column("block")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    size = 1 << (_BLOCK_BITS - 3)
    for r in blocks.groupBy("block").applyInArrow(run, "block long, bits binary").toLocalIterator():
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = keys.view(np.uint64) & np.uint64((1 << TABLE_BITS) - 1)
    return (table[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def occurrence(id_hash: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """A name for a place in a row; equal only for rows with the same id and text."""
    x = (id_hash.view(np.uint64) * _MIX) ^ (packed.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x165667B19E3779F9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _first(source: DataFrame, length: int, seed: int) -> DataFrame:
    """(anchor, whole, place) of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for part, raw, at, lo in parts_of(batch, length):
                row, start, n, offset, anchor, whole = stretches(raw, at, length, seed, rolling)
                key = part.column(part.schema.get_field_index("row")).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor.view(np.int64), whole.view(np.int64), occurrence(key, pack(start + lo, n, offset)))], names=["anchor", "whole", "place"])

    return source.mapInArrow(run, "anchor long, whole long, place long")


def _second(source: DataFrame, length: int, seed: int, again, look, hot) -> DataFrame:
    """Rows of the stretches that may occur again (with `whole`), and of those to compare (with `bytes`, or the name of each window)."""
    kind = source.schema["id"].dataType.simpleString()
    names = ["id", "key", "packed", "anchor", "whole", "bytes", "window"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, no, seen = Rolling(), lambda n, t: pa.nulls(n, t), set()
        for batch in batches:
            for part, raw, at, lo in parts_of(batch, length):
                row, start, n, offset, anchor, whole = stretches(raw, at, length, seed, rolling)
                key = part.column(1).to_numpy()
                packed, anchor, whole = pack(start + lo, n, offset), anchor.view(np.int64), whole.view(np.int64)
                ids = part.column(0)

                def rows(which, packed_, whole_=None, bytes_=None, window=None, row=row, anchor=anchor, ids=ids, key=key):
                    m = len(which)
                    return pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(row[which])), pa.array(key[row[which]]), pa.array(packed_), pa.array(anchor[which]),
                            no(m, pa.int64()) if whole_ is None else pa.array(whole_), no(m, pa.binary()) if bytes_ is None else pa.array(bytes_, pa.binary()), no(m, pa.int64()) if window is None else pa.array(window),
                        ],
                        names=names,
                    )

                full = np.flatnonzero(in_table(again.value, whole ^ anchor))
                yield rows(full, packed[full], whole_=whole[full])
                places = occurrence(part.column(part.schema.get_field_index("row")).to_numpy()[row], packed)
                few = np.flatnonzero(in_table(look.value, places))
                # rows that repeat id and text have the same places; one of them is enough
                first = []
                for i, place in zip(few.tolist(), places[few].tolist(), strict=True):
                    if place not in seen:
                        seen.add(place)
                        first.append(i)
                few = np.array(first, np.int64)
                if len(seen) > MOST_SEEN:
                    seen.clear()
                many = np.isin(anchor[few], hot.value)
                cold, spread = few[~many], few[many]
                flat, begin = raw.tobytes(), start + at[row]
                yield rows(cold, packed[cold], bytes_=[flat[b : b + k + length - 1] for b, k in zip(begin[cold].tolist(), n[cold].tolist(), strict=True)])
                if len(spread):
                    each = np.repeat(spread, n[spread])
                    step = np.arange(len(each)) - np.repeat(np.cumsum(n[spread]) - n[spread], n[spread])
                    p = begin[each] + step
                    # windows with the anchor at the same place are told by all their bytes
                    window = np.fromiter((xxhash.xxh3_64_intdigest(flat[i : i + length], k) for i, k in zip(p.tolist(), (offset[each] - step).tolist(), strict=True)), np.uint64, len(p))
                    yield rows(each, (start[each] + step + lo) << 24 | (1 << 12), window=window.view(np.int64))

    return source.mapInArrow(run, f"id {kind}, key long, packed long, anchor long, whole long, bytes binary, window long")


def grow(strings: list[bytes], offsets: np.ndarray, length: int, seed: int, rolling: Rolling) -> list[np.ndarray]:
    """For stretches with the same anchor: which windows of each occur again among them.

    Windows are ranked by their first bytes, twice as many each round; those of unique rank drop out,
    and the bytes of those that are left are compared.
    """
    raw = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    n = np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1
    row = np.repeat(np.arange(len(strings)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    p = ends[row] - (n + length - 1)[row] + step
    rank = (offsets[row] - step).astype(np.uint64)  # equal windows have the anchor at the same place
    left, sums, have = np.arange(len(row)), rolling.load(raw), 0
    while have < length and len(left):
        more = min(max(2 * have, seed), length)
        rank = (rank * _MIX) ^ rolling.of(sums, p[left] + have, p[left] + more)
        _, which, count = np.unique(rank, return_inverse=True, return_counts=True)
        again = count[which] > 1
        left, rank, have = left[again], rank[again], more
    order = np.argsort(rank, kind="stable")
    left, rank = left[order], rank[order]
    head = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(left) else left
    first = np.repeat(head, np.diff(np.append(head, len(left))))
    windows = np.lib.stride_tricks.sliding_window_view(raw, length)
    same = np.concatenate([(windows[p[left[k : k + 4096]]] == windows[p[left[first[k : k + 4096]]]]).all(1) for k in range(0, len(left), 4096)]) if len(left) else np.zeros(0, bool)
    if not same.all():  # names that clash: the bytes themselves decide
        at = (offsets[row] - step)[left]
        names = Counter(zip(at.tolist(), map(bytes, windows[p[left]]), strict=True))
        left = left[[names[k, bytes(w)] > 1 for k, w in zip(at.tolist(), windows[p[left]], strict=True)]]
    hit = np.zeros(len(row), bool)
    hit[left] = True
    return np.split(hit, np.cumsum(n)[:-1])


def runs(hit: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """Byte ranges that the hit windows cover."""
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return list(zip((np.flatnonzero(edge == 1) + start).tolist(), (np.flatnonzero(edge == -1) + start + length - 1).tolist(), strict=True))


def _third(cold: DataFrame, length: int, seed: int) -> DataFrame:
    """(id, key, start, end) of repeats between stretches of one anchor; an anchor's rows may go over several batches."""
    kind = cold.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held = Rolling(), None

        def out(table: pa.Table) -> pa.RecordBatch:
            anchors = table.column("anchor").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(anchors)) + 1, [len(anchors)]])
            strings, packed = table.column("bytes").to_pylist(), table.column("packed").to_numpy()
            rows, starts, ends = [], [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e - s < 2:
                    continue
                for i, hit in enumerate(grow(strings[s:e], packed[s:e] & 4095, length, seed, rolling), s):
                    if hit.any():
                        for a, b in runs(hit, int(packed[i]) >> 24, length):
                            rows.append(i)
                            starts.append(a)
                            ends.append(b)
            own = table.select(["id", "key"]).take(pa.array(rows, pa.int64())).combine_chunks()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.columns]
            return pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else c.chunk(0) for c in columns), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["id", "key", "start", "end"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            table = now if held is None else pa.concat_tables([held, now])
            anchors = table.column("anchor").to_numpy()
            last = int(np.searchsorted(anchors, anchors[-1])) if len(anchors) else 0
            if last:
                yield out(table.slice(0, last))
            held = table.slice(last)
        if held is not None and held.num_rows > 1:
            yield out(held)

    ordered = cold.select("id", "key", "packed", "anchor", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(run, f"id {kind}, key long, start long, end long")


def repeats(source: DataFrame, length: int, seed: int) -> DataFrame:
    """(id, key, start, end): byte ranges of (id, key, text) rows made of windows that occur again; ranges may overlap."""
    if not 2 <= seed < length <= 4000:
        raise ValueError("2 <= seed < length <= 4000 is needed")
    sc = source.sparkSession.sparkContext
    ranked = _first(source, length, seed).groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    # one row for each different stretch whose anchor occurs again
    per = ranked.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.min("n").alias("least")).filter("total > 1")
    known = written(ranked.join(per, "anchor").select("anchor", "whole", "n", "place", "kinds", ((F.col("kinds") > 1) & (F.col("least") == 1)).alias("open")))
    sizes = known.filter("open").agg(F.count("*").alias("n")).first()
    limit = max(MOST_STRETCHES, -(-sizes.n // MOST_HOT))
    hot = sorted(r.anchor for r in known.filter(F.col("open") & (F.col("kinds") > limit)).select("anchor").distinct().collect())  # MOST_HOT at most
    again = known.filter("n > 1")
    tables = bit_table(again.select(F.col("whole").bitwiseXOR(F.col("anchor")).alias("k")), "k"), bit_table(known.filter("open").select("place"), "place")
    second = written(_second(source, length, seed, *(sc.broadcast(x) for x in (*tables, np.array(hot, np.int64)))))
    start = F.shiftright("packed", 24)
    end = start + F.shiftright("packed", 12).bitwiseAND(F.lit(4095)) + (length - 1)
    full = second.filter("whole IS NOT NULL").join(again.select("anchor", "whole"), ["anchor", "whole"]).select("id", "key", start.alias("start"), end.alias("end"))
    cold = _third(second.filter("bytes IS NOT NULL"), length, seed)
    spread = second.filter("window IS NOT NULL").select("id", "key", "packed", "anchor", "window")
    often = spread.groupBy("anchor", "window").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "window")
    warm = spread.join(often, ["anchor", "window"]).select("id", "key", start.alias("start"), end.alias("end"))
    return full.unionByName(cold).unionByName(warm)


def merge(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of ranges that overlap or touch."""
    order = np.lexsort((ends, starts))
    s, e = np.asarray(starts, np.int64)[order], np.maximum.accumulate(np.asarray(ends, np.int64)[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
    return list(zip(s[new].tolist(), e[last].tolist(), strict=True))


def _marked(docs: DataFrame, id_col: str, text_col: str, length: int, seed: int) -> DataFrame:
    """(id, packed text, spans) of every row; each row meets the ranges of its id and text."""
    source = docs.select(docs[id_col].alias("id"), text_column(docs, text_col))
    key = F.xxhash64("text")
    source = source.select("id", key.alias("key"), "text", F.xxhash64("id", key).alias("row"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(1)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([packer.compress(t.encode()) for t in part.column(2).to_pylist()], pa.binary())], names=["id", "key", "packed"])

    kind = source.schema["id"].dataType.simpleString()
    found = repeats(source, length, seed).groupBy("id", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    found = found.select(F.col("id").alias("i"), F.col("key").alias("k"), "spans")
    texts = source.mapInArrow(squeeze, f"id {kind}, key long, packed binary")
    return texts.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left").select("id", "packed", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, seed: int = 32) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row; kept holds the remaining bytes.

    A byte goes if a string of `length` bytes that covers it starts anywhere else in the table too.
    Null texts are empty; shorter texts stay whole; repeated rows are copies of one another, so all
    of their bytes go if they are long enough.  Very long texts are searched whole, in overlapping
    parts; other columns don't matter; an empty table gives none.
    """
    marked = _marked(docs, id_col, text_col, length, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = []
                for packed, starts, ends in zip(*(part.column(j).to_pylist() for j in (1, 2, 3)), strict=True):
                    text = unpack(packed)
                    spans = merge(starts, ends) if starts else []
                    cuts = [0, *(x for s in spans for x in s), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                    rows.append((len(text), len(text) - len(kept), len(spans), kept))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = marked.schema["id"].dataType.simpleString()
    return marked.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    """The columns of query op7."""
    return removed(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

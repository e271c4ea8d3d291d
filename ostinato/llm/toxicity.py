"""Toxicity from FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of the words' beginnings (languages
that inflect hide a stem behind many endings), of pairs of neighbours and of pairs with one
word between them.  Weights are learned online with per-coordinate rates; the L1 term
keeps all but a few at zero, so that the model is a short sorted list that is broadcast.
Learning takes a bounded sample of labelled rows; scoring takes every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Rolling, as_bytes, inner_text, slices, word_bounds, written

#: Labelled rows of each class that learning takes at most, and bytes of their features (4 for each different one of a text).
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 24 << 20
#: Ranges in which the sample of a label reaches the driver, one after another, so that it never holds a sample in several copies.
SAMPLE_PARTS = 16
_FILTER_BITS = 20
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


#: Bytes of a word's beginnings.
STEMS = (4, 5)
_TABLE = np.frombuffer(ALNUM, np.uint8)


def features(raw: np.ndarray, at: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """32-bit features of all rows (with repeats), and the row of each."""
    text = _TABLE[raw]
    start, end, row = word_bounds(text, at)
    sums = rolling.load(text)
    h = rolling.of(sums, start, end)
    found, rows = [h * _A], [row]
    for n in STEMS:
        found.append((rolling.of(sums, start, np.minimum(start + n, end)) + np.uint64(n)) * _B)
        rows.append(row)
    for gap in (1, 2):
        same = row[gap:] == row[:-gap]
        found.append(((h[:-gap][same] * _B + np.uint64(gap)) ^ (h[gap:][same] * _C)) * _A)
        rows.append(row[gap:][same])
    return (np.concatenate(found) >> np.uint64(32)).astype(np.uint32), np.concatenate(rows)


@dataclass
class Model:
    """Sparse weights: sorted features, their weights, and the bias."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def scores(self, raw: np.ndarray, at: np.ndarray, rolling: Rolling, near: np.ndarray) -> np.ndarray:
        total = np.full(len(at) - 1, self.bias)
        if len(self.keys):
            keys, rows = features(raw, at, rolling)
            few = near[keys >> np.uint32(32 - _FILTER_BITS)]
            keys, rows = keys[few], rows[few]
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[place] == keys
            pairs = np.unique(rows[hit] * len(self.keys) + place[hit])  # a feature counts once in a text
            total += np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], len(total))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

    def near(self) -> np.ndarray:
        """A table of leading bits that rules out most features at once."""
        table = np.zeros(1 << _FILTER_BITS, bool)
        table[self.keys >> np.uint32(32 - _FILTER_BITS)] = True
        return table


def ftrl(rows: list[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 15.0, l2: float = 0.1, epochs: int = 6, least_rows: int = 3) -> Model:
    """Learn from (distinct features, label) rows in their order; features of fewer than `least_rows` rows are left out."""
    if len({y for _, y in rows}) < 2:  # nothing to tell apart
        return Model(bias=500.0 if rows and rows[0][1] else -np.inf)
    flat = np.sort(np.concatenate([x for x, _ in rows]))
    head = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    every = flat[head[np.diff(np.append(head, len(flat))) >= least_rows]]
    del flat, head
    size = len(every)
    found = np.empty(sum(len(x) for x, _ in rows) + len(rows), np.int32)  # the numbers of all rows' features in one array
    bounds = [0]
    for x, _ in rows:
        place = np.searchsorted(every, x)
        place = place[place < size]
        place = place[every[place] == x[: len(place)]]  # x is sorted, so what lies beyond `every` is at its end
        found[bounds[-1] : bounds[-1] + len(place)] = place
        bounds.append(bounds[-1] + len(place) + 1)
        found[bounds[-1] - 1] = size  # the last is the bias
    z, n = np.zeros(len(every) + 1), np.zeros(len(every) + 1)
    sparse = np.append(np.full(len(every), l1), 0.0)

    def weights(k) -> np.ndarray:
        over = np.abs(z[k]) - sparse[k]
        return np.where(over > 0, -np.sign(z[k]) * over / ((beta + np.sqrt(n[k])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for at, end, (_, y) in zip(bounds[:-1], bounds[1:], rows, strict=True):
            k = found[at:end]
            w = weights(k)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha * w
            n[k] += g * g
    w = weights(np.arange(len(z)))
    own = np.flatnonzero(w[:-1])
    return Model(every[own].astype(np.uint32), w[own], float(w[-1]))


def in_fold(id_col: Column, folds: int, fold: int) -> Column:
    """True where the crc32 of the id as text leaves `fold`; a null id is in no fold."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def first_rows(found: DataFrame, rows: int, parts: int = SAMPLE_PARTS) -> Iterator:
    """Up to `rows` rows (h, x) of found, in their order; a range at a time reaches the driver."""
    last = found.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    few = found.filter(F.col("h") <= last)  # ties at the last h are cut below
    return islice(few.repartitionByRange(parts, "h", "x").sortWithinPartitions("h", "x").toLocalIterator(), rows)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, folds: int = 5, held_out: int = 0) -> Model:
    """A model from at most `sample_rows` rows and `sample_bytes` of features of each label outside the held-out fold.

    Rows are chosen by a hash of id and text, so the same table gives the same model.  Where more of
    one label are left out than of the other, the bias is put right for it, so that scores mean the
    same at every size.  Null ids, texts and labels are left out; of equal ids with both labels 1
    holds; with no two labels to tell apart, all scores are the one label.  A very long text counts with all its
    different features, as far as `sample_bytes` goes (at least one row of each label is taken whole).
    """
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").filter(~in_fold(F.col("id"), folds, held_out))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model()
    spread = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1_000_003)) / 1_000_003
    rate = F.lit(0.0)
    for y, n in counts.items():
        rate = F.when(F.col("y") == y, min(1.0, 1.1 * sample_rows / n)).otherwise(rate)  # a tenth more than are taken
    few = known.filter(spread("id") < rate).groupBy("id").agg(F.max("y").alias("y"))  # of bounded size, see `rate`
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).filter("text IS NOT NULL").join(F.broadcast(few), "id").select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for part in slices(batch, limit=1 << 19):
                raw, at = as_bytes(part.column(2))
                keys, rows = features(raw, at, rolling)
                order = np.argsort(rows, kind="stable")
                cuts = np.searchsorted(rows[order], np.arange(1, part.num_rows))
                own = [np.unique(x).tobytes() for x in np.split(keys[order], cuts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary())], names=["id", "y", "x"])

    found = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, y int, x binary")
    found = written(found.select(F.xxhash64("id", "x").alias("h"), "y", "x"))
    rows, odds = [], 0.0
    for y in counts:
        own = found.filter(F.col("y") == y)
        total, flat, used, taken = own.count(), np.empty(1 << 16, np.uint32), 0, 0
        for r in first_rows(own, sample_rows):
            x = np.frombuffer(r.x, np.uint32)
            if taken and 4 * (used + len(x)) > sample_bytes:
                break
            while used + len(x) > len(flat):
                flat = np.concatenate([flat, np.empty_like(flat)])
            flat[used : used + len(x)] = x  # one array, so that nothing small stays behind in the driver
            rows.append((r.h, y, len(rows), used, used + len(x)))
            used, taken = used + len(x), taken + 1
        rows = [(*row[:3], flat[row[3] : row[4]]) if len(row) == 5 else row for row in rows]
        # of the rows with this label, those of the ids chosen, and of those the ones taken
        share = taken / max(total, 1) * min(1.0, 1.1 * sample_rows / counts[y])
        odds += (1 if y == 0 else -1) * np.log(max(share, 1e-12))
    model = ftrl([(x, y) for _, y, _, x in sorted(rows, key=lambda row: row[:3])])
    return Model(model.keys, model.weights, model.bias + odds) if np.isfinite(model.bias) and len(model.keys) else model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and `score`, the chance of label 1; null and empty texts get what the bias gives.

    A column of docs named `score` is replaced.  Very long texts are scored whole, repeated rows get the
    same score, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]
    source = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, own = Rolling(), shared.value
        near = own.near()
        for batch in batches:
            for part in slices(batch, text_col, 1 << 19, inner=True):
                raw, at = as_bytes(inner_text(part, text_col))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.scores(raw, at, rolling, near))], names=["row", "score"])

    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, score double").select("row.*", "score")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score under the threshold, with their own columns.

    Null and empty texts have what the bias gives (under one half where most labels are 0); very long
    texts are scored whole; repeated rows stay or go together; an empty table stays empty.
    """
    found = score(docs.withColumnRenamed("score", "_score"), learn(docs, labels, id_col, text_col), id_col, text_col)
    return found.filter(F.col("score") < threshold).drop("score").withColumnRenamed("_score", "score")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op1."""
    docs = docs.select("doc_id", "text")
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

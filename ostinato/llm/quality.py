"""Quality scores from random Fourier features of document statistics.

Statistics of each whole text (shares of signs, repetition, shapes of words and lines) are written
once.  Cosines of random projections approximate a Gaussian kernel on them; the normal equations
of a ridge regression are sums over rows, so each partition sends its own sum, one for each inner fold.
Sums alone choose the ridge.  Scores of each fold by the others' model are then calibrated by isotonic
regression over fixed bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, as_bytes, dropped, slices, text_column, word_bounds, written
from .toxicity import in_fold

#: Random features, inner folds, bins of raw scores for calibration, and how far these reach.
FEATURES, INNER, BINS, LOW, HIGH = 384, 5, 2000, -0.5, 1.5
#: The kernel's width, in standard deviations of a statistic times the square root of their number.
WIDTH = 1.0
RIDGES = (1e-5, 1e-4, 1e-3, 1e-2)
#: Labelled rows that one task sums, about.
ROWS_A_TASK = 1_000_000
_BLOCK = 64

NAMES = [
    "chars", "words", "lines", "lower", "upper", "digit", "space", "mark", "sign", "stop", "beyond", "entropy", "word_size", "word_spread", "long_words", "short_words", "signed_words",
    "capital_words", "numbers", "titled", "distinct", "word_entropy", "top_word", "twins", "again3", "line_size", "again_lines", "ended_lines", "short_lines", "signed_lines", "wordy_lines", "max_sign_line",
]
_LOWER, _UPPER, _DIGIT, _SPACE, _MARK, _SIGN, _STOP, _BEYOND, _INSIDE = range(9)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = _LOWER, _UPPER, _DIGIT
_CLASS[[32, *range(9, 14)]] = _SPACE
_CLASS[[ord(c) for c in ",;:'\"()-"]] = _MARK
_CLASS[[ord(c) for c in ".!?"]] = _STOP
_CLASS[0x80:0xC0], _CLASS[0xC0:] = _INSIDE, _BEYOND
_WORDS = np.where(_CLASS == _SPACE, 32, np.arange(256)).astype(np.uint8)
_LINES = np.arange(256, dtype=np.uint8)
_LINES[32], _LINES[10] = 1, 32
#: Bytes in 64 groups for the entropy of characters: letters in one case, the rest by class and low bits.
_GROUPS = (np.arange(256) % 16 + 48).astype(np.uint8)
_GROUPS[97:123] = _GROUPS[65:91] = np.arange(26)
_GROUPS[48:58] = 26 + np.arange(10)


def _counts(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: different hashes, hashes that occur more than once (all occurrences), the most frequent one's count, sum of c log c."""
    if not len(rows):
        return (np.zeros(n),) * 4
    bits = np.uint64(64 - n.bit_length())
    keys = np.sort((rows.astype(np.uint64) << bits) | (hashes >> (np.uint64(64) - bits)))
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    c = np.diff(np.append(head, len(keys)))
    r = (keys[head] >> bits).astype(np.int64)
    top = np.zeros(n)
    last = np.flatnonzero(np.append(r[1:] != r[:-1], True))
    first = np.concatenate([[0], last[:-1] + 1])
    top[r[first]] = np.maximum.reduceat(c, first)
    return np.bincount(r, minlength=n).astype(float), np.bincount(r, c * (c > 1), n), top, np.bincount(r, c * np.log(c), n)


def statistics(raw: np.ndarray, at: np.ndarray, rolling: Rolling) -> np.ndarray:
    """A row of numbers (`NAMES`) for each text: square roots of shares, logarithms of counts; an empty text has zeros."""
    n = len(at) - 1
    kind = _CLASS[raw]

    def within(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return (sums[end] - sums[start]).astype(float)

    size = (at[1:] - at[:-1]).astype(float)
    where = np.repeat(np.arange(n), at[1:] - at[:-1])
    lower, upper, digit, space, mark, sign, stop, beyond, inside = np.bincount(where * 9 + kind, minlength=9 * n).reshape(n, 9).T.astype(float)
    chars = size - inside
    share = lambda a, b: np.sqrt(np.divide(a, b, out=np.zeros(n), where=b > 0))
    mean = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    group = np.bincount(where * 64 + _GROUPS[raw], minlength=64 * n).reshape(n, 64)
    p = group / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(1)

    text = _WORDS[raw]
    start, end, row = word_bounds(text, at)
    words = np.bincount(row, minlength=n).astype(float)
    long = (end - start - within(kind == _INSIDE, start, end)).astype(float)
    signs, caps, letters, digits = (within(m, start, end) for m in (kind == _SIGN, kind == _UPPER, kind <= _UPPER, kind == _DIGIT))
    of = lambda m: np.bincount(row, m, n)
    titled = of(kind[start] == _UPPER)
    size_mean = mean(of(long), words)
    spread = np.sqrt(np.maximum(mean(of(long * long), words) - size_mean**2, 0))
    h = rolling.of(rolling.load(text), start, end)
    distinct, _, top, c_log_c = _counts(row, h, n)
    word_entropy = np.log(np.maximum(words, 1)) - mean(c_log_c, words)
    same2, same3 = row[1:] == row[:-1], row[2:] == row[:-2]
    twins = np.bincount(row[1:][same2], (h[1:] == h[:-1])[same2], n)
    three = (h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + h[2:]
    _, again3, _, _ = _counts(row[2:][same3], three[same3], n)

    text = _LINES[raw]
    start, end, line_row = word_bounds(text, at)
    lines = np.bincount(line_row, minlength=n).astype(float)
    line_size = (end - start).astype(float)
    own = lambda m: np.bincount(line_row, m, n)
    different, _, _, _ = _counts(line_row, rolling.of(rolling.load(text), start, end), n)
    line_signs = within(kind == _SIGN, start, end) / np.maximum(line_size, 1)
    most = np.zeros(n)
    np.maximum.at(most, line_row, line_signs)
    out = [
        np.log1p(chars), np.log1p(words), np.log1p(lines), share(lower, chars), share(upper, chars), share(digit, chars), share(space, chars), share(mark, chars), share(sign, chars), share(stop, chars), share(beyond, chars), entropy,
        np.log1p(size_mean), np.log1p(spread), share(of(long > 12), words), share(of(long < 3), words), share(of(signs > 0), words), share(of((caps == letters) & (letters > 1)), words), share(of(digits == long), words), share(titled, words),
        share(distinct, words), word_entropy, share(top, words), share(twins, words), share(again3, words), np.log1p(mean(own(line_size), lines)), share(lines - different, lines), share(own(kind[end - 1] == _STOP), lines), share(own(line_size < 30), lines), share(own(line_signs > 0.05), lines), share(own(line_size > 200), lines), np.sqrt(most),
    ]
    return np.stack(out, 1).astype(np.float32)


def projections(width: float = WIDTH, features: int = FEATURES, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(len(NAMES), features)) / (width * np.sqrt(len(NAMES))), rng.uniform(0, 2 * np.pi, features)


@dataclass
class Model:
    """Means and spreads of statistics, random projections, weights (the last is the constant), and the steps of the calibration."""

    mean: np.ndarray
    spread: np.ndarray
    turns: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    known: np.ndarray
    chance: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Inner products of these come near a Gaussian kernel of the standardised rows; a one is appended."""
        z = np.cos(np.clip((x - self.mean) / self.spread, -6, 6) @ self.turns + self.shift) * np.sqrt(2 / len(self.shift))
        return np.concatenate([z, np.ones((len(x), 1))], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.known, self.chance)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to `value`, by pooling neighbours that are out of order."""
    pools: list[list[float]] = []  # mean, weight, length
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]
    return np.concatenate([np.full(int(k), v) for v, _, k in pools]) if pools else np.zeros(0)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): statistics of every whole text; null is empty."""
    source = docs.select(docs[id_col].alias("id"), text_column(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                x = statistics(*as_bytes(part.column(1)), rolling)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32), x.ravel())], names=["id", "x"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, x array<float>")


def _rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(batch.num_rows, len(NAMES)).astype(float)


def _equations(known: DataFrame, model: Model, inner: int) -> np.ndarray:
    """For each inner fold the sums of z z', z y, and y y: an array of (fold, features + 2, features + 2)."""
    wide = len(model.shift) + 2
    shared = known.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((inner, wide, wide))
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                zy = np.concatenate([shared.value.features(_rows(part, 0)), np.asarray(part.column(1), float)[:, None]], 1)
                fold = np.asarray(part.column(2))
                for f in range(inner):
                    own = zy[fold == f]
                    total[f] += own.T @ own
        for f in range(inner):
            for row in range(0, wide, _BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([row], pa.int32()), pa.array([total[f, row : row + _BLOCK].tobytes()], pa.binary())], names=["fold", "row", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for f, row, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(own)
                total[f, row] = total[f, row] + own if (f, row) in total else own
        for (f, row), own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([row], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["fold", "row", "sums"])

    kind = "fold int, row int, sums binary"
    out = np.zeros((inner, wide, wide))
    # blocks of rows of each fold's matrix meet in tasks of their own; the driver gets one matrix a fold
    for r in known.select("x", "y", "fold").mapInArrow(sums, kind).repartition("fold", "row").mapInArrow(added, kind).collect():
        out[r.fold, r.row : r.row + _BLOCK] += np.frombuffer(r.sums).reshape(-1, wide)
    return out


def ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Weights for summed equations; the penalty is a share of the number of rows, and spares the constant."""
    size = sums.shape[0] - 1
    loss = np.full(size, penalty * max(sums[size - 1, size - 1], 1.0))
    loss[-1] = 1e-9
    return np.linalg.solve(sums[:size, :size] + np.diag(loss), sums[:size, size])


def _lost(sums: np.ndarray, w: np.ndarray) -> float:
    """Squared error of weights on the rows that were summed."""
    size = len(w)
    return float(sums[size, size] - 2 * w @ sums[:size, size] + w @ sums[:size, :size] @ w)


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", folds: int = 4, held_out: int = 2, inner: int = INNER) -> Model:
    """A model from all labelled rows of (id, x) outside the held-out fold; the driver gets sums of fixed size.

    Null ids and labels other than 0 and 1 are left out, repeated rows count each; of an id with both
    labels 1 holds.  Without labels every score is 0.5, with one label only it is that one.
    """
    own = labels.select(labels[id_col].alias("k"), labels[label_col].try_cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)").filter(~in_fold(F.col("k"), folds, held_out)).groupBy("k").agg(F.max("y").alias("y"))
    paths: list[str] = []
    known = written(stats.join(own, F.col("id") == F.col("k")).select("x", "y", F.pmod(F.xxhash64("id"), F.lit(inner)).cast("int").alias("fold")), paths)
    every = [F.avg(F.get("x", F.lit(k))).alias(f"a{k}") for k in range(len(NAMES))] + [F.stddev_pop(F.get("x", F.lit(k))).alias(f"s{k}") for k in range(len(NAMES))]
    moments = np.array([v or 0.0 for v in stats.agg(*every).first()])
    mean, spread = moments[: len(NAMES)], np.maximum(moments[len(NAMES) :], 1e-3)
    count = known.agg(F.count("*").alias("n"), F.min("y").alias("least"), F.max("y").alias("most")).first()
    turns, shift = projections()
    flat = np.array([LOW, HIGH])
    model = Model(mean, spread, turns, shift, np.zeros(len(shift) + 1), flat, np.full(2, 0.5 if not count.n else float(count.least)))
    if count.n and count.least != count.most:
        known = known.coalesce(max(1, -(-count.n // ROWS_A_TASK))) if count.n < ROWS_A_TASK else known.repartition(-(-count.n // ROWS_A_TASK))
        sums = _equations(known, model, inner)
        total = sums.sum(0)
        apart = lambda penalty: [ridge(total - sums[f], penalty) for f in range(inner)]
        best = min(RIDGES, key=lambda penalty: sum(_lost(sums[f], w) for f, w in enumerate(apart(penalty))))
        others = np.stack(apart(best))
        model.weights = ridge(total, best)
        shared = known.sparkSession.sparkContext.broadcast((model, others))

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((2, BINS), np.int64)
            for batch in batches:
                for k in range(0, batch.num_rows, 4096):
                    part = batch.slice(k, 4096)
                    raw = (shared.value[0].features(_rows(part, 0)) * shared.value[1][np.asarray(part.column(2))]).sum(1)
                    bin_ = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
                    np.add.at(n, (np.asarray(part.column(1)), bin_), 1)
            some = np.flatnonzero(n.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[0, some]), pa.array(n[1, some])], names=["bin", "zeros", "ones"])

        rows = known.mapInArrow(binned, "bin int, zeros bigint, ones bigint").groupBy("bin").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).orderBy("bin").collect()
        bins, zeros, ones = (np.array([r[k] for r in rows], float) for k in range(3))
        model.known = LOW + (bins + 0.5) * (HIGH - LOW) / BINS
        model.chance = isotonic(ones / (zeros + ones), zeros + ones)
    dropped(stats.sparkSession, paths)
    return model


def predict(stats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every row of (id, x)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(_rows(part, 1)))], names=["id", "score"])

    return stats.mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score) of every row of docs: the chance of label 1, learned from the labels.

    Null and empty texts are scored by their statistics, which are zeros; a very long text counts whole;
    repeated rows get the same score; other columns, whatever their names, don't matter; an empty table gives no rows.
    """
    stats = written(described(docs, id_col, text_col))
    return predict(stats, learn(stats, labels, id_col, label_col), id_col)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op13."""
    found = score(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

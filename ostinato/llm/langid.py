"""Language identification with error-correcting output codes.

Each language has a codeword; a binary classifier over hashed byte n-grams predicts each bit.
Decoding takes the codeword with the smallest loss, where bits that were learned well weigh
more, and flags texts whose best two codewords are close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, slices, text_column
from .toxicity import in_fold

#: Rows of each language that learning takes at most, rows of all, and languages: the ones with most rows.
SAMPLE_ROWS, SAMPLE_TOTAL, MOST_LANGUAGES = 600, 12_000, 200
DIMENSIONS = 4096
UNKNOWN = "und"
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:128] = 32
_LETTERS[65:91] = _LETTERS[97:123] = np.arange(97, 123)
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def vectors(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of norm 1 for each text: square roots of the shares of its hashed n-grams of 1 to 3 bytes."""
    t = _LETTERS[raw].astype(np.uint32)
    grams = [t, t[:-1] * np.uint32(257) + t[1:] + np.uint32(1), (t[:-2] * np.uint32(66049) + t[1:-1] * np.uint32(257) + t[2:]) + np.uint32(2)]
    grams = [((g * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64) for g in grams]
    out = np.zeros((len(at) - 1, DIMENSIONS), np.float32)
    for i, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)):
        for k, g in enumerate(grams):
            if e - s > k:
                out[i] += np.bincount(g[s : e - k], minlength=DIMENSIONS)
    np.sqrt(out, out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A +-1 codeword for each of n languages: all columns that split up to 5 of them, else random ones that lie far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if i == 0 or (bits >> (i - 1)) & 1 else -1 for bits in range(2 ** (n - 1) - 1)] for i in range(n)])
    rng, width, best, far = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, width))
        code = code[:, np.abs(code.sum(0)) < n]  # each bit must split the languages
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, lead over the second in mean loss a bit) of each row."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * word) * self.trust).sum(1) for word in self.code], 1)
        chance = np.exp(loss.min(1, keepdims=True) - loss)
        chance /= chance.sum(1, keepdims=True)
        least = np.sort(loss, 1)[:, :2] / self.trust.sum()
        return chance.argmax(1), chance.max(1), least[:, 1] - least[:, 0] if least.shape[1] > 1 else np.full(len(x), np.inf)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 250, rate: float = 8.0, l2: float = 1e-4) -> Model:
    """Logistic regressions for all bits at once by gradient descent with momentum; each language weighs the same."""
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((DIMENSIONS, 1), np.float32), np.ones(1, np.float32), np.ones(1))
    target = code[y].astype(np.float32)
    weight = (1 / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)
    weight = (weight / weight.sum())[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        pull = -target * weight / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        vw = 0.9 * vw - rate * (x.T @ pull + l2 * w)
        vb = 0.9 * vb - rate * pull.sum(0)
        w, b = w + vw, b + vb
    right = ((np.sign(x @ w + b) == target) * weight).sum(0)
    trust = np.log(np.clip(right, 0.5, 0.999) / (1 - np.clip(right, 0.5, 0.999))) + 1e-3
    return Model(languages, code, w, b, trust / trust.mean())


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_total: int = SAMPLE_TOTAL, most_languages: int = MOST_LANGUAGES, folds: int = 4, held_out: int = 2) -> Model | None:
    """A model from at most `sample_rows` rows of each language outside the held-out fold; None if there are none.

    Of more than `most_languages` values those with most rows are learned (ties: the first by name), and of many
    languages fewer rows each, so that the driver gets `sample_total` rows at most.

    Rows are chosen by a hash of id and text; each comes to the driver as a vector of fixed size.  Null texts and languages and texts without letters are left out.
    """
    known = docs.select(docs[id_col].alias("id"), docs[lang_col].cast("string").alias("y"), docs[text_col].cast("string").alias("text")).filter("y IS NOT NULL AND text IS NOT NULL").filter(~in_fold(F.col("id"), folds, held_out))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(most_languages).collect()}
    if not counts:
        return None
    sample_rows = max(1, min(sample_rows, sample_total // len(counts)))
    rates = docs.sparkSession.createDataFrame([(y, min(1.0, 1.5 * sample_rows / n)) for y, n in counts.items()], "y string, rate double")
    known = known.withColumn("h", F.xxhash64(F.col("id").cast("string"), "text"))
    few = known.join(F.broadcast(rates), "y").filter(F.pmod("h", F.lit(1_000_003)) / 1_000_003 < F.col("rate")).drop("rate")  # a row per language, `most_languages` at most
    # equal rows of one id and text are chosen together, so the bound is kept by number
    number = F.row_number().over(Window.partitionBy("y").orderBy("h", "id", "text"))
    few = few.withColumn("k", number).filter(F.col("k") <= sample_rows).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                raw, at = as_bytes(part.column(1))
                x = vectors(raw, at).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["y", "x"])

    rows = [(r.y, np.frombuffer(r.x, np.float16)) for r in few.mapInArrow(run, "y string, x binary").orderBy("y", F.xxhash64("x"), "x").toLocalIterator()]
    rows = [(y, x) for y, x in rows if x.any()]
    if not rows:
        return None
    languages = sorted({y for y, _ in rows})
    number = {y: k for k, y in enumerate(languages)}
    return fit(np.stack([x for _, x in rows]).astype(np.float32), np.array([number[y] for y, _ in rows]), languages)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", lead: float = 0.4) -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every row.

    Texts that are null or have no letter get `und` with score 0, as do all without a model.
    `ambiguous` marks texts whose best two codewords differ by less than `lead` in mean loss a bit (texts of
    one language differ by 1 to 3, halves of two languages by 0.3 at most); of languages that tie, the
    first by name is given.  Very long texts count whole; repeated rows are predicted alike; other
    columns don't matter; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(docs[id_col].alias("id"), text_column(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in (p for s in slices(batch, limit=1 << 20) for p in (s.slice(k, 256) for k in range(0, s.num_rows, 256))):
                raw, at = as_bytes(part.column(1))
                n = part.num_rows
                names, scores, close = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
                if own is not None:
                    which, p, ahead = own.decode(vectors(raw, at))
                    sums = np.concatenate([[0], np.cumsum(_ASCII[raw])])
                    for i in range(n):
                        if sums[at[i + 1]] > sums[at[i]] or any(map(str.isalpha, raw[at[i] : at[i + 1]].tobytes().decode())):
                            names[i], scores[i], close[i] = own.languages[which[i]], p[i], ahead[i] < lead
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(close)], names=["id", "lang_pred", "score", "ambiguous"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    """The columns of query op8."""
    docs = docs.select("doc_id", "text", "lang")
    return predict(docs, learn(docs)).withColumn("held_out", in_fold(F.col("doc_id"), 4, 2))

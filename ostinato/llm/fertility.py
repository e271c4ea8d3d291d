"""Quality rules from tokeniser fertility, beside counts of words, symbols and repeats.

Public vocabularies measure each text: characters per token, the share of byte-fallback tokens and
the entropy of its tokens.  A text is rejected when a measure leaves the band of its script (or of
its language, where a language column is given).  Entropy is also held against fertility, as bits a
character: writing of any kind either repeats its tokens or has long ones, and random letters, keys
or encoded data do neither.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, as_bytes, slices, text_column, word_bounds, word_hashes
from .packing import WordTokenizer

VOCABULARIES = ("piece_bpe_32k.model", "word_bpe_49k.json")


@dataclass(frozen=True)
class Band:
    """Limits of a script or language: characters per token, share of byte-fallback tokens, bits of entropy a token, and bits a character.

    They hold for the first vocabulary.  `least_lower` are characters per token of the second, which
    lower-cases, and `most_gain` is how many times those of the first they may be.
    """

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    most_bits: float
    least_lower: float = 0.0
    most_gain: float = 10.0


#: By script (lower-case name) or language; `none` is for texts with hardly a letter, `other` for the rest.
#: Latin: texts of 50 words or more that sf0.1 labels as good (invented prose in four languages) have at least
#: 1.63 characters a token in both vocabularies, 5.5 bits a token and at most 3.69 bits a character and a gain
#: of 1.15; written English has about 3.9, 4.0, 7.8, 2.0 and 1.0.  Texts that say a few words over and over
#: have 3.3 to 4.8 bits a token (the same as lists and forms, so the limit lies low), text in capitals a gain of
#: 1.1 to 1.3; random letters have 5.1 bits a character, base64 5.9, hex digits 4.2.
#: Of the other scripts the tables have no text.  Shares of bytes lie between those of sentences written by hand
#: (Chinese 0.05, Japanese 0.16, Korean 0.21, Hindi 0.12, Armenian and Bengali 0.24, none in Russian, Greek, Arabic,
#: Hebrew and Georgian) and of random characters of the script (0.89, 0.5, 0.92, 0.62; cuneiform 0.94, Greek 0.12,
#: Arabic 0.16): what the vocabulary can't write goes.  The other limits shut out what repeats or mixes tokens beyond any writing.
BANDS = {
    "latin": Band(1.4, 8.0, 0.1, 3.7, 3.74, 1.5, 1.18),
    "cyrillic": Band(1.1, 8.0, 0.08, 3.0, 5.0),
    "greek": Band(0.6, 6.0, 0.08, 3.0, 6.5),
    "arabic": Band(0.6, 6.0, 0.12, 3.0, 7.0),
    "hebrew": Band(0.6, 6.0, 0.12, 3.0, 7.0),
    "devanagari": Band(0.5, 6.0, 0.4, 3.0, 9.0),
    "han": Band(0.3, 4.0, 0.4, 3.0, 14.0),
    "kana": Band(0.4, 4.0, 0.4, 3.0, 12.0),
    "hangul": Band(0.3, 4.0, 0.5, 3.0, 14.0),
    "none": Band(1.2, 8.0, 0.5, 3.0, 3.5),
    "other": Band(0.2, 10.0, 0.6, 2.0, 20.0),
}
#: Characters of a text that are letters at least, in hundredths, for it to have a script.
LEAST_LETTERS = 20
#: First code points of runs, and their scripts.
_RUNS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0x20000, "han"), (0x32000, "other")]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WHITE = np.where(_SPACE, 32, np.arange(256)).astype(np.uint8)
_START = (np.arange(256) & 0xC0) != 0x80


def script_of(text: str, size: int) -> str:
    """The script of most letters, `none` where fewer than `LEAST_LETTERS` in a hundred characters (without white space) are some; `size` is the number of bytes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = codes[(codes >= 0x80) | ((codes | 32) - 97 < 26)]
    if 100 * len(letters) < LEAST_LETTERS * int(((codes > 32) & (codes != 0xA0)).sum()) or not len(letters):
        return "none"
    if size == len(text):
        return "latin"
    names = [name for _, name in _RUNS]
    counts = np.bincount(np.maximum(np.searchsorted([c for c, _ in _RUNS], letters, "right") - 1, 0), minlength=len(names))
    totals: dict[str, int] = {}
    for name, n in zip(names, counts.tolist(), strict=True):
        totals[name] = totals.get(name, 0) + n
    return max(totals, key=totals.get)


@cache
def pieces_of(path: str) -> tuple[WordTable, np.ndarray]:
    """Tokens of words by a sentencepiece vocabulary that never joins text over white space, and which of its tokens are bytes; one for each worker."""
    import sentencepiece

    inner = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.fromiter((inner.is_byte(k) for k in range(inner.vocab_size())), bool)
    return WordTable(lambda words: inner.encode(words, num_threads=1), 600_000), is_byte


@cache
def lower_of(path: str) -> WordTokenizer:
    return WordTokenizer(path, 600_000)


def repeat_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    _, flat = np.unique(ids, return_inverse=True)
    key = flat.astype(np.int64)
    for step in (1, 2):
        _, pair = np.unique(key[:-1] * (len(ids) + 1) + flat[step:], return_inverse=True)
        key = pair.astype(np.int64)
    often = np.bincount(key)[key] > 1
    hit = np.zeros(len(ids), bool)
    for step in range(3):
        hit[step : step + len(often)] |= often
    return int(hit.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def entropies(ids: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Bits of entropy a token of each text, from the shares of its tokens; 0 without tokens."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    kinds, times = np.unique(np.repeat(np.arange(n), sizes) * size + ids, return_counts=True)
    many = np.maximum(sizes, 1)
    return np.log2(many) - np.bincount(kinds // size, times * np.log2(times), n) / many


def measure(docs: DataFrame, vocabularies: Sequence[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, bands: dict[str, Band] | None = None, least_tokens: int = 20) -> DataFrame:
    """Counts, measures and verdict of every text.

    Columns: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    chars_per_token, byte_share, entropy, lower_chars_per_token, band, kept.  The first vocabulary is a
    sentencepiece model with byte fallback, the second, if given, one that lower-cases.  Null texts have
    no words; texts without tokens measure 0; texts of fewer than `least_tokens` tokens keep within any
    band, and no text needs more entropy than four fifths of what its number of tokens allows.  With `lang_col`, the band of the language is taken where there is one, else that of the
    script.  Very long texts are measured whole; repeated rows are measured alike; other columns don't
    matter; an empty table gives none.
    """
    limits = bands or BANDS
    lang = docs[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    source = docs.select(docs[id_col].alias("id"), lang.alias("lang"), text_column(docs, text_col))
    first, second = vocabularies[0], vocabularies[1] if len(vocabularies) > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, is_byte = pieces_of(first)
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                raw, at = as_bytes(part.column(2))
                flat, n = raw.tobytes(), part.num_rows
                texts = [flat[at[i] : at[i + 1]] for i in range(n)]
                start, end, row = word_bounds(_WHITE[raw], at)
                total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
                chars, symbols = total(_START[raw] & ~_SPACE[raw]), total(_SYMBOL[raw])
                cuts = np.searchsorted(row, np.arange(n + 1))
                counts = np.diff(cuts)
                lines = np.fromiter(map(duplicate_lines, texts), np.int64, n)
                repeats = np.fromiter(map(repeat_words, np.split(word_hashes(raw, start, end), cuts[1:-1])), np.int64, n)
                ids, each = words.look_up(raw, flat, start, end)
                bounds = np.concatenate([[0], each.cumsum()])[cuts]
                sizes = np.diff(bounds)
                many = np.maximum(sizes, 1)
                fallback = np.bincount(np.repeat(np.arange(n), sizes), is_byte[ids], n)
                entropy = entropies(ids, bounds, len(is_byte))
                per, share = chars / many, fallback / many
                lower = chars / np.maximum(np.diff(lower_of(second).encode(raw, at)[1]), 1) if second else np.full(n, np.inf)
                failed = (counts < 50) | (100 * repeats > 50 * counts)
                langs = part.column(1).to_pylist()
                names = [x if x in limits else script_of(t.decode(), len(t)) for x, t in zip(langs, texts, strict=True)]
                own = [limits.get(x) or limits["other"] for x in names]
                lo, hi, most, least, bits, low, gain = (np.array([getattr(b, f.name) for b in own]) for f in fields(Band))
                inside = (per >= lo) & (per <= hi) & (share <= most) & (entropy >= np.minimum(least, 0.8 * np.log2(many))) & (entropy <= bits * per) & (lower >= low) & (np.isinf(lower) | (lower <= gain * per))
                good = (sizes < least_tokens) | inside
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, (counts, chars, symbols, lines, repeats, failed, per, share, entropy, np.where(np.isinf(lower), np.nan, lower))), pa.array(names, pa.string()), pa.array(~failed & good)],
                    names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_per_token", "byte_share", "entropy", "lower_chars_per_token", "band", "kept"],
                )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chars_per_token double, byte_share double, entropy double, lower_chars_per_token double, band string, kept boolean").withColumnRenamed("id", id_col)


def fit(measured: DataFrame, tail: float = 0.001, room: float = 0.08) -> dict[str, Band]:
    """Bands from the measures of a table, one for each script or language in it: quantiles of all its rows that base rules keep, and some room.

    A row of few numbers for each band reaches the driver.  Rows that base rules reject, null and empty texts
    among them, are left out; repeated rows count each; an empty table, or one without kept rows, gives no bands.
    """
    q = lambda c, p: F.percentile_approx(c, p, 10_000)
    bits = F.col("entropy") / F.greatest(F.col("chars_per_token"), F.lit(1e-9))
    found = measured.filter("NOT base_failed").groupBy("band").agg(
        q("chars_per_token", tail).alias("lo"), q("chars_per_token", 1 - tail).alias("hi"), q("byte_share", 1 - tail).alias("share"), q("entropy", tail).alias("least"), q(bits, 1 - tail).alias("bits"), q("lower_chars_per_token", tail).alias("low"),
        q(F.col("lower_chars_per_token") / F.greatest(F.col("chars_per_token"), F.lit(1e-9)), 1 - tail).alias("gain"),
    )
    wide = lambda x, up: x * (1 + room if up else 1 - room)
    return {r.band: Band(wide(r.lo, False), wide(r.hi, True), min(1.0, wide(r.share, True) + 0.01), wide(r.least, False), wide(r.bits, True), wide(r.low, False), wide(r.gain, True)) for r in found.collect()}


def vocabularies() -> list[str]:
    """The public vocabularies of query op3."""
    import public_tokenizers

    return [public_tokenizers.path(name) for name in VOCABULARIES]


def report(docs: DataFrame) -> DataFrame:
    """The columns of query op3."""
    return measure(docs.select("doc_id", "text"), vocabularies())

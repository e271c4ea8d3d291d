"""Personal data: patterns for the base, and a semi-Markov conditional random field for the rest.

The field scores whole candidate segments (shape, digit groups, separators, checksums, words
before) and a dynamic program over segments of bounded length chooses boundaries and kinds
jointly.  It works on the stretches around digits and @ signs that no base span explains, and adds
a span where its chance is high.  Its weights are learned from generated sentences.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, inner_text, slices, text_column

#: The order of equal starts.
KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
#: Whole lists of numbers, @ signs and spelled-out ones.
_SEED = re.compile(r"[0-9]++(?:(?:\x20?[,;:/|-]\x20?|[\x20.\t])?[0-9]++)*+|@|[\[(] ?at ?[\])]", re.I)
_AT = re.compile(r"[\[(] ?at ?[\])]", re.I)
#: Spelled-out and spaced signs of addresses, as the signs that they stand for.
_SIGNS = [(re.compile(r" ?[\[(] ?at ?[\])] ?| @ ?|@ ", re.I), "@"), (re.compile(r" ?[\[(] ?(?:dot|punkt|point) ?[\])] ?| \. ", re.I), "."), (re.compile(r"[\[(]\.[\])]"), ".")]
_MAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,8}")


#: Between numbers that go on, and what may stand before the sign of an address, spelled out or not.
_AHEAD = re.compile(r"(?:\x20?[,;:/|-]\x20?|[\x20.\t])?[0-9]")
_BEHIND = re.compile(r"[0-9](?:\x20?[,;:/|-]\x20?|[\x20.\t])?\Z")
_NEXT = re.compile(r"[^0-9A-Za-z]{1,3}(?=[0-9])")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]* ?[\[(]? ?")
_DIGITS = re.compile(r"[0-9]+")


@dataclass(frozen=True)
class Limits:
    """What bounds the entities that the field looks for: longer ones are left to the patterns, which have no limit.

    A segment has at most `tokens` tokens (runs of digits, of letters, other signs) and `chars`
    characters, and begins and ends within `around` characters of a digit run, an @ or a spelled-out one.
    """

    tokens: int = 24
    chars: int = 64
    around: int = 48


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _small(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) < 4 and int(number or 0) <= 255


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all base matches by start, then kind.

    The pattern of an email is looked up from each @ sign, so that long runs of letters stay linear.
    """
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, "email", m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    found += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end()))
    found += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def features(text: str, start: int, end: int) -> list[str]:
    """What the field knows of a whole segment and its surroundings."""
    own = text[start:end]
    groups = re.findall("[0-9]+", own)
    digits = "".join(groups)
    shape = re.sub("[0-9]+", lambda m: f"<{len(m[0])}>", re.sub(r"[^\W\d_]+", "a", own))
    signs = "".join(sorted({c for c in own if not c.isalnum()}))
    before = re.search(r"([^\W\d_]+)\W{0,4}$", text[max(0, start - 24) : start])
    plain = own
    for pattern, sign in _SIGNS:
        plain = pattern.sub(sign, plain)
    mail, last = _MAIL.fullmatch(plain), plain.rsplit(".", 1)[-1]
    dotted = plain.split(".")
    whole = f"{text[start - 1 : start].isalnum() or text[start - 1 : start] in ('-', '_', '.', '+', '%', '@')} {text[end : end + 1] in ('-', '_', '@') or text[end : end + 1].isalnum()}"
    return [
        f"shape {shape}", f"digits {min(len(digits), 20)}", f"groups {len(groups)} {signs}", f"signs {signs}",
        f"ends {own[0] if not own[0].isalnum() else 'd' if own[0].isdigit() else 'a'} {'d' if own[-1].isdigit() else 'a' if own[-1].isalpha() else own[-1]}",
        f"letters {any(map(str.isalpha, own))} {'@' in own} {bool(_AT.search(own))} {'.' in own}",
        f"check {14 <= len(digits) <= 19} {luhn(digits)}", f"parts {len(groups) == 4 and all(map(_small, groups))} {signs}",
        f"cue {before[1].lower() if before else ''}", f"near {text[start - 1 : start]} {text[end : end + 1]}", "any",
        f"mail {bool(mail)} {len(last) if mail else ''} {whole}", f"address {len(dotted) == 4 and plain != own and all(d.isascii() and d.isdigit() and _small(d) for d in dotted)} {whole}",
    ]


def segments(text: str, start: int, end: int, limits: Limits = Limits()) -> tuple[list[int], list[tuple[int, int]]]:
    """Bounds of the tokens of a stretch, and the candidate segments as pairs of places in them."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    bounds = [s for s, _ in tokens] + [end]
    open_ = [text[s].isalnum() or text[s] in "+([" for s, _ in tokens]
    close = [text[e - 1].isalnum() or text[e - 1] in ")]" for _, e in tokens]
    out = []
    for i in range(len(tokens)):
        s = bounds[i]
        if not open_[i] or (s and text[s - 1].isalnum() and text[s].isalnum()):
            continue
        seed = False
        for j in range(i + 1, min(i + limits.tokens, len(tokens)) + 1):
            e = bounds[j]
            if e - s > limits.chars or text[e - 1] == "\n":
                break
            seed = seed or text[bounds[j - 1]].isdigit() or text[e - 1] == "@" or text[bounds[j - 1] : e].lower() == "at"
            if seed and j > i + 2 and close[j - 1] and not (text[e - 1].isalnum() and text[e : e + 1].isalnum()):
                out.append((i, j))
    return bounds, out


def _goes_on(text: str, at: int, sign: str, ahead: bool) -> bool:
    """Whether a number goes on at this place: digits, or digits behind what stands between numbers of a list or behind `sign`, which stands inside too."""
    if ahead:
        return _AHEAD.match(text, at) is not None or bool(sign) and text.startswith(sign, at) and text[at + len(sign) : at + len(sign) + 1].isdigit()
    return _BEHIND.search(text[max(0, at - 4) : at]) is not None or bool(sign) and text.endswith(sign, 0, at) and text[max(0, at - len(sign) - 1) : max(0, at - len(sign))].isdigit()


def possible(text: str, s: int, e: int) -> bool:
    """Whether a segment could be of some kind.

    It reads as an address once spelled-out signs are signs; or it has no letters, as many digits as a
    phone or a card or four short groups of them, and stands alone, so that no number goes on at its
    ends.  So hardly any segment of a table of numbers is possible.
    """
    own = text[s:e]
    if "@" in own or _AT.search(own):
        plain = own
        for pattern, sign in _SIGNS:
            plain = pattern.sub(sign, plain)
        return _MAIL.fullmatch(plain) is not None
    groups = list(_DIGITS.finditer(own))
    digits = sum(m.end() - m.start() for m in groups)
    if not (10 <= digits <= 19 or len(groups) == 4 and all(m.end() - m.start() <= 3 for m in groups)) or any(map(str.isalpha, own)):
        return False
    first, last = (own[groups[0].end() : groups[1].start()], own[groups[-2].end() : groups[-1].start()]) if len(groups) > 1 else ("", "")
    return not _goes_on(text, s, first, False) and not _goes_on(text, e, last, True)


def candidates(text: str, start: int, end: int, limits: Limits = Limits()) -> tuple[list[int], list[tuple[int, int]]]:
    """`segments` that are `possible`, without a look at most others: their digits are summed and their signs counted on the way."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    bounds, n, out = [s for s, _ in tokens] + [end], len(tokens), []
    signs = list(accumulate((text[s] == "@" or e - s == 2 and text[s:e].lower() == "at" and text[max(0, s - 2) : s].rstrip(" ")[-1:] in ("[", "(") for s, e in tokens), initial=0))
    for i in range(n):
        s, stop = bounds[i], min(i + limits.tokens, n)
        first = text[s]
        if not (first.isalnum() or first in "+([") or (s and text[s - 1].isalnum() and first.isalnum()):
            continue
        mail = signs[stop] > signs[i]
        if mail:  # what stands before the first sign must be a name
            at = i
            while signs[at + 1] == signs[i]:
                at += 1
            mail = _NAME.fullmatch(text, s, bounds[at]) is not None
        if not mail:
            if first.isalpha() or first.isdigit() and _goes_on(text, s, "", False):
                continue
            if first.isdigit() and bounds[i + 1] - s < 10 and (m := _NEXT.match(text, bounds[i + 1])) and _goes_on(text, s, m[0], False):
                continue
        digits, seed = 0, False
        for j in range(i + 1, stop + 1):
            at, e = bounds[j - 1], bounds[j]
            c = text[at]
            if e - s > limits.chars or text[e - 1] == "\n":
                break
            if c.isdigit():
                seed, digits = True, digits + e - at
            elif signs[j] > signs[j - 1]:
                seed = True
            if not mail and (digits > 19 or c.isalpha()):
                break
            if seed and j > i + 2 and (text[e - 1].isalnum() or text[e - 1] in ")]") and not (text[e - 1].isalnum() and text[e : e + 1].isalnum()):
                if (signs[j] > signs[i] if mail else digits >= 4) or digits >= 4:
                    if possible(text, s, e):
                        out.append((i, j))
    return bounds, out


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b))) if max(a, b) > -math.inf else -math.inf


@dataclass
class Field:
    """Weights of features for each kind."""

    weights: dict[str, list[float]] = field(default_factory=dict)

    def scores(self, found: list[str]) -> list[float]:
        total = [0.0] * len(KINDS)
        for f in found:
            if w := self.weights.get(f):
                for k, x in enumerate(w):
                    total[k] += x
        return total

    def chances(self, n: int, places: list[tuple[int, int]], scores: list[list[float]]) -> list[list[float]]:
        """The chance of each segment and kind, given all ways to cut n tokens into segments and single outside tokens."""
        ends, starts = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(places):
            ends[j].append(k)
            starts[i].append(k)
        left, right = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            left[j] = left[j - 1]
            for k in ends[j]:
                for s in scores[k]:
                    left[j] = _add(left[j], left[places[k][0]] + s)
        for i in range(n - 1, -1, -1):
            right[i] = right[i + 1]
            for k in starts[i]:
                for s in scores[k]:
                    right[i] = _add(right[i], right[places[k][1]] + s)
        return [[math.exp(left[i] + s + right[j] - left[n]) for s in own] for (i, j), own in zip(places, scores, strict=True)]

    def best(self, n: int, places: list[tuple[int, int]], scores: list[list[float]]) -> list[tuple[int, int]]:
        """(segment, kind) pairs of the best way."""
        ends = [[] for _ in range(n + 1)]
        for k, (_, j) in enumerate(places):
            ends[j].append(k)
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for k in ends[j]:
                for kind, s in enumerate(scores[k]):
                    if value[places[k][0]] + s > value[j]:
                        value[j], back[j] = value[places[k][0]] + s, (k, kind)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                out.append(back[j])
                j = places[back[j][0]][0]
        return out[::-1]

    def spans(self, text: str, base: list[tuple[int, str, int]], least: float = 0.8, limits: Limits = Limits()) -> list[tuple[int, str, int]]:
        """Spans beside the base, in the stretches around seeds that it leaves."""
        taken, runs = [(s, e) for s, _, e in base], []
        gaps, at = [], 0
        for s, e in sorted(taken):
            gaps.append((at, s))
            at = max(at, e)
        gaps.append((at, len(text)))
        for lo, hi in gaps:
            for m in _SEED.finditer(text, lo, hi) if hi > lo else ():
                long = m.end() - m.start() > 19
                if long and (m.end() - m.start() > limits.chars or sum(map(str.isdigit, m[0])) > 19):
                    continue  # a list goes on at each place inside it, and all of it is too much
                s, e = max(lo, m.start() - limits.around), min(hi, m.end() + limits.around)
                if runs and s <= runs[-1][1] and runs[-1][0] >= lo:
                    runs[-1][1] = e
                else:
                    runs.append([s, e])
        out = []
        for s, e in runs:
            bounds, places = candidates(text, s, e, limits)
            if not places:
                continue
            scores = [self.scores(features(text, bounds[i], bounds[j])) for i, j in places]
            if max(map(max, scores)) <= 0:  # then no segment is in the best way
                continue
            chosen = self.best(len(bounds) - 1, places, scores)
            if chosen:
                chances = self.chances(len(bounds) - 1, places, scores)
                out += [(bounds[places[k][0]], KINDS[kind], bounds[places[k][1]]) for k, kind in chosen if chances[k][kind] >= least]
        return out

    def learn(self, n: int, places: list[tuple[int, int]], found: list[list[str]], right: list[int], rate: float, seen: dict[str, list[float]]) -> None:
        """One step up the likelihood of a sentence of n tokens, with a rate for each weight; right: the kind of each segment, or -1."""
        chances = self.chances(n, places, [self.scores(x) for x in found])
        for own, kind, p in zip(found, right, chances, strict=True):
            pull = [(k == kind) - x for k, x in enumerate(p)]
            if max(map(abs, pull)) < 1e-3:
                continue
            for f in own:
                w, g = self.weights.setdefault(f, [0.0] * len(KINDS)), seen.setdefault(f, [1.0] * len(KINDS))
                for k, x in enumerate(pull):
                    g[k] += x * x
                    w[k] += rate * (x - 1e-3 * w[k]) / math.sqrt(g[k])


def prepared(text: str, gold: list[tuple[int, str, int]]) -> tuple[int, list[tuple[int, int]], list[list[str]], list[int]]:
    """What learning needs of a sentence: its tokens, segments, their features and kinds."""
    bounds, places = candidates(text, 0, len(text))
    kinds = {(s, e): KINDS.index(kind) for s, kind, e in gold}
    return len(bounds) - 1, places, [features(text, bounds[i], bounds[j]) for i, j in places], [kinds.get((bounds[i], bounds[j]), -1) for i, j in places]


def sentences(n: int, seed: int = 5) -> Iterator[tuple[str, list[tuple[int, str, int]]]]:
    """Generated sentences with the spans in them; numbers of other kinds are the counter-examples."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))
    free = lambda: r.choice([word(), word(), word().title(), word() + "-" + word()])

    def card() -> str:
        head = r.choice("3456") + digits(r.choice([13, 14, 14, 14]))
        number = next(head + c for c in "0123456789" if luhn(head + c))
        return r.choice([number, ".".join(number[k : k + 4] for k in range(0, len(number), 4)), "  ".join(number[k : k + 4] for k in range(0, len(number), 4)), "/".join(number[k : k + 4] for k in range(0, len(number), 4))])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"00{digits(2)} {a} {b} {c}", f"+{digits(2)}/{a}/{b}{c}"])

    def email() -> str:
        name = r.choice([word(), word(), f"{word()}.{word()}", word() + digits(2), f"{word()[0]}.{word()}", f"{word()}_{word()}", f"{word()}_{word()[0]}{digits(2)}"])
        host, top = r.choice([word(), word(), f"{word()}-{word()}", f"{word()}.{word()}"]), r.choice(["com", "org", "net", "de", "fr", "pl", "co.uk", "info"])
        at = r.choice([" @ ", " [at] ", "[at]", " (at) ", "(at)", "@ ", " @"])
        dot = r.choice([".", ".", " [dot] ", "[dot]", " (dot) ", "(dot)"]) if "@" not in at or r.random() < 0.5 else "."
        return f"{name}{at}{dot.join([*host.split('.'), *top.split('.')])}" if r.random() < 0.9 else f"{name}@{host} . {top}"

    def ip() -> str:
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice(["[.]", " . ", "(.)"]).join(parts)

    def other() -> str:
        return r.choice([
            f"{r.randint(1900, 2030)}", f"{digits(2)}.{digits(2)}.{r.randint(1990, 2030)}", f"{r.randint(1990, 2030)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
            f"${r.randint(1, 999)},{digits(3)}.{digits(2)}", f"{digits(3)}-{digits(4)}", f"{r.randint(1, 400)} - {r.randint(1, 400)}", digits(r.randint(1, 20)), f"{digits(4)} {digits(4)} {digits(4)} {digits(3)}", f"{word()}_{digits(4)}", f"{word()} = {digits(3)}.{digits(2)}", f"sk-{word()}{digits(6)}{word()}", f"{r.randint(256, 999)}.{digits(3)}.{digits(2)}.{digits(1)}", f"@{word()}", f"{digits(1)} {digits(1)} {digits(1)}", f"({digits(4)})", f"[{digits(2)}]", f"{digits(5)}-{digits(3)}-{digits(5)}", f"{digits(2)}%", f"v{digits(1)}.{digits(1)}", f"({word()} {r.randint(1900, 2030)})", f"{word()}[at] {word()}", f"{word()} (at) {word()}", f"{word()}[{digits(1)}] @ {word()}[{digits(1)}]", f"{word()} @ {digits(1)}.{digits(2)}", f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(4)} . {digits(2)}", f"{digits(1)} - {digits(1)} ({digits(1)} - {digits(1)})",
        ])

    makers = {"email": (email, ["mail", "Mail", "contact", "email", "write to", "under", "is", ""]), "ip": (ip, ["host", "server", "Block", "at", "ip", ""]), "card": (card, ["card", "visa", "Card number", "with", "pay", ""]), "phone": (phone, ["call", "Call", "phone", "number is", "tel", "fax", ""])}
    for _ in range(n):
        text, spans = " ".join(free() for _ in range(r.randint(0, 3))), []
        for _ in range(r.randint(1, 2)):
            text += r.choice([" ", " ", ", ", ". ", "\n"]) if text else ""
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                make, cues = makers[kind]
                own, cue = make(), r.choice([*cues, word()])
                text += f"{cue}{r.choice([' ', ': '])}" if cue else ""
                spans.append((len(text), kind, len(text) + len(own)))
            else:
                own = other()
            text += own + r.choice([" ", ".", ", ", ""]) + " ".join(free() for _ in range(r.randint(0, 2)))
        yield text, spans


@cache
def trained(n: int = 700, epochs: int = 4, rate: float = 0.3) -> Field:
    """The field, learned from n generated sentences; the same each time."""
    own, seen, same = Field(), {}, {}
    every = [(n_, places, [[same.setdefault(f, f) for f in x] for x in found], right) for n_, places, found, right in (prepared(*x) for x in sentences(n))]
    for _ in range(epochs):
        for sentence in every:
            own.learn(*sentence, rate, seen)
    return own


def all_spans(text: str, own: Field, limits: Limits = Limits()) -> list[tuple[int, str, int, bool]]:
    """(start, kind, end, base) by start, then kind."""
    base = base_spans(text)
    more = own.spans(text, base, limits=limits)
    return sorted([(*x, True) for x in base] + [(*x, False) for x in more], key=lambda x: (x[0], KINDS.index(x[1])))


_MARK = np.zeros(256, bool)
_MARK[list(b"0123456789@")] = True


def _each(batches: Iterator[pa.RecordBatch], own: Field, text: str, inner: bool = False, limits: Limits = Limits()) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches with the spans of their rows; texts without a seed aren't decoded."""
    for batch in batches:
        for part in slices(batch, text, inner=inner):
            raw, at = as_bytes(inner_text(part, text) if inner else part.column(part.schema.get_field_index(text)))
            marks = np.diff(np.concatenate([[0], np.cumsum(_MARK[raw])])[at])
            flat, out = raw.tobytes(), []
            for i in range(part.num_rows):
                t = flat[at[i] : at[i + 1]]
                seeds = marks[i] or re.search(rb"[\[(] ?at ?[\])]", t, re.I)
                out.append(all_spans(t.decode(), own, limits) if seeds else [])
            yield part, out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(id, pii) of every row: spans by start (code points), then kind; `base` marks those of the patterns.

    Null and empty texts have none; repeated rows get equal ones; an empty table gives none.  Very long
    texts are searched whole, in stretches around digits and @ signs; spans that the field adds keep
    within `limits` (entities are bounded in this method), those of the patterns have any length.
    Of ways to cut a text that are equally good the one with fewer spans is taken; other columns don't matter.
    """
    own = docs.sparkSession.sparkContext.broadcast(trained())
    source = docs.select(docs[id_col].alias("id"), text_column(docs, text_col))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _each(batches, own.value, "text", limits=limits):
            rows = [[{"kind": k, "start": s, "end": e, "base": b} for s, k, e, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["id", "pii"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, pii {SPANS}").withColumnRenamed("id", id_col)


def cover(text: str, spans: list[tuple[int, str, int, bool]]) -> str:
    """The text with `<KIND>` for each span; overlapping spans are one, of the first's kind."""
    out, at = [], 0
    for s, kind, e, _ in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """All columns of docs, with `<KIND>` in place of personal data; `size_col` gets the new number of code points.

    Null and empty texts stay as they are; repeated rows are treated alike; very long texts are
    searched whole (`find`); other columns, whatever their names, are passed on; an empty table stays empty.
    """
    own = docs.sparkSession.sparkContext.broadcast(trained())
    source = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _each(batches, own.value, text_col, inner=True, limits=limits):
            texts = part.column(0).field(text_col).cast(pa.string()).to_pylist()
            new = [cover(t, x) if x else t for t, x in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string())], names=["row", "seen"])

    out = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, seen string")
    new = {text_col: F.col("seen").alias(text_col)} | ({size_col: F.length("seen").cast(docs.schema[size_col].dataType).alias(size_col)} if size_col else {})
    return out.select(*[new.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """The columns of query op2; the counts are of base spans."""
    found = find(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined("pii").alias("spans"), (F.size("pii") - F.size(base)).cast("long").alias("n_added"))

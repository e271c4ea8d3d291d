"""URL rules in sorted digest arrays.

An array holds the 64-bit xxhash of each rule (host and path prefix), sorted, beside the rules'
full strings and verdicts, in one file that each Python worker memory-maps.  All forms of a URL that
a rule could fit are probed at once by binary search; what is found is confirmed against the stored
string, so equal digests of different strings do no harm.  Larger sets of rules make several arrays.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules in one array, and so what the driver holds at once; further ones make further arrays.
BLOCK_RULES = 5_000_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both are empty without a `://`.  Only A-Z of the host are lower-cased."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    stop = min((k for k in (rest.find("?", end), rest.find("#", end)) if k >= 0), default=len(rest))
    host = rest[:end]
    return (host.lower() if host.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in host)), rest[end:stop]


class DigestArray:
    """Sorted keys, bounds, codes and bytes of strings in one file: count, keys, bounds, codes, bytes."""

    def __init__(self, path: str):
        flat = np.memmap(path, np.uint8, "r")
        n = int(flat[:8].view(np.uint64)[0])
        self.keys = flat[8 : 8 + 8 * n].view(np.uint64)
        self.bounds = flat[8 + 8 * n : 16 + 16 * n].view(np.uint64)
        self.codes = flat[16 + 16 * n : 16 + 24 * n].view(np.int64)
        self.data = flat[16 + 24 * n :]

    @staticmethod
    def pack(strings: Sequence[bytes], digest=xxhash.xxh64_intdigest, codes: Sequence[int] | None = None) -> tuple[bytes, np.ndarray]:
        """The file's bytes and, for each place in the array, the number of its string."""
        keys = np.fromiter(map(digest, strings), np.uint64, len(strings))
        order = np.argsort(keys, kind="stable")
        ordered = [strings[k] for k in order]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in ordered])]).astype(np.uint64)
        own = np.zeros(len(strings), np.int64) if codes is None else np.asarray(codes, np.int64)
        return b"".join([np.uint64(len(strings)).tobytes(), keys[order].tobytes(), bounds.tobytes(), own[order].tobytes(), *ordered]), order

    def find(self, strings: Sequence[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """The place of each string, or -1."""
        out = np.full(len(strings), -1, np.int64)
        if not len(self.keys) or not len(strings):
            return out
        probes = np.fromiter(map(digest, strings), np.uint64, len(strings))
        lo, hi = np.searchsorted(self.keys, probes, "left"), np.searchsorted(self.keys, probes, "right")
        for i in np.flatnonzero(hi > lo):
            for k in range(lo[i], hi[i]):
                if self.data[int(self.bounds[k]) : int(self.bounds[k + 1])].tobytes() == strings[i]:
                    out[i] = k
                    break
        return out


def ship(spark: SparkSession, data: bytes) -> str:
    """Give every executor the file; its name there."""
    name = f"digests-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    if any(url.endswith(name) for url in spark.sparkContext.listFiles):
        return name
    path = os.path.join(tempfile.mkdtemp(prefix="ostinato-"), name)
    with open(path, "wb") as file:
        file.write(data)
    spark.sparkContext.addFile(path)  # Spark's own file server copies it to each executor
    return name


def blocks_of(rules: Sequence[Rule] | DataFrame, block_rules: int) -> Iterator[list[Rule]]:
    """The different rules in blocks of about `block_rules`; only one block is held at a time if they come as a DataFrame."""
    if not isinstance(rules, DataFrame):
        own = list({r.name: r for r in rules}.values())
        yield from (own[k : k + block_rules] for k in range(0, max(len(own), 1), block_rules))
        return
    path = F.coalesce(F.col("path").cast("string"), F.lit("/")) if "path" in rules.columns else F.lit("/")
    known = rules.filter("host IS NOT NULL AND verdict IS NOT NULL").groupBy(F.concat(F.col("host"), path).alias("name")).agg(F.max(F.struct("verdict", "host", path.alias("path"))).alias("r"))
    n = max(1, -(-known.count() // block_rules))
    for k in range(n):
        yield [Rule(x.r.verdict, x.r.host, x.r.path) for x in known.filter(F.pmod(F.xxhash64("name"), F.lit(n)) == k).toLocalIterator()]


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, otherwise: str = "allow", url_col: str = "url", block_rules: int = BLOCK_RULES) -> DataFrame:
    """All columns of pages, then host, path, rule and verdict (columns with these names are replaced).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins
    (of equally long ones, the one with the longer host).  Without one, rule is null and the verdict
    is `otherwise`, as for null and malformed urls; very long urls are judged whole, repeated rows
    alike, and an empty table gives none.  Rules are a sequence (of repeated ones, the last holds) or
    a DataFrame (verdict, host, path; of repeated ones the greatest verdict holds, and null is no rule).
    """
    files, said, lengths, longest = [], {}, set(), 0
    for own in blocks_of(rules, block_rules):
        codes = [said.setdefault(r.verdict, len(said)) for r in own]
        files.append(ship(pages.sparkSession, DigestArray.pack([r.name.encode() for r in own], codes=codes)[0]))
        lengths |= {len(r.path.encode()) for r in own}
        longest = max([longest, *(len(r.host.encode()) for r in own)])
    verdicts, lengths = list(said), sorted(lengths, reverse=True)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    source = pages.select(F.struct(*[pages[c] for c in kept]).alias("row"), pages[url_col].cast("string").alias("url"))

    def forms(host: bytes, path: bytes) -> Iterator[bytes]:
        at = 0
        while at >= 0:
            if len(host) - at <= longest:
                for n in lengths:
                    if n <= len(path):
                        yield host[at:] + path[:n]
            at = host.find(b".", at) + 1 or -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [DigestArray(SparkFiles.get(name)) for name in files]
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [list(forms(h.encode(), p.encode())) for h, p in parts]
            flat = [x for each in found for x in each]
            codes = np.full(len(flat), -1, np.int64)
            for array in arrays:
                places = array.find(flat)
                codes[places >= 0] = array.codes[places[places >= 0]]
            names, said, at = [], [], 0
            for each in found:
                hits = [(len(x), -i, x, k) for i, (x, k) in enumerate(zip(each, codes[at : at + len(each)], strict=True)) if k >= 0]
                at += len(each)
                best = max(hits, default=None)
                names.append(best[2].decode() if best else None)
                said.append(verdicts[best[3]] if best else otherwise)
            text = lambda x: pa.array(x, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text([h for h, _ in parts]), text([p for _, p in parts]), text(names), text(said)], names=["row", "host", "path", "rule", "verdict"])

    shape = f"row {source.schema['row'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return source.mapInArrow(run, shape).select("row.*", "host", "path", "rule", "verdict")


#: The rules of query op6.
RULES = (
    Rule("allow", "com"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def report(pages: DataFrame) -> DataFrame:
    """The columns of query op6."""
    return judge(pages.select("page_id", "url"), RULES).drop("url")

"""Repair of conversation structure, with one solution for each distinct sequence of roles and faults.

A conversation's turns become a short string, its signature: a letter for each turn says the
role's initial and the fault that counts.  Far fewer signatures than conversations exist, so each
is solved once, by memoised recursion for the cheapest edits; audits are joined back to
conversations, and the edits replayed on their turns.

Turns are dealt to blocks of bounded size.  A conversation of one block is solved whole; a longer
one has its blocks solved for every state that they may begin and end in, and a chain over those few
numbers chooses the states, so that no task holds more than a block of its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A block holds turns of about so many bytes; each turn counts as `TURN_BYTES` more, so that a block has about 1000 turns at most.
BLOCK_BYTES, TURN_BYTES = 8 << 20, 8 << 10
#: Conversations of more bytes than this (counted alike) are put in order by several tasks.
WHOLE_BYTES = 256 << 20
#: Ranges of turns are cut by so much of a text.
KEY_CHARS = 64
#: Solved ends of signatures that a task keeps, and turns of a signature whose ends stay for others.
MEMO, MEMO_TURNS = 300_000, 64

_BLANK = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"

#: States are what stands last so far: nothing, the system turn, a user turn, an assistant turn.
_AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
#: The state after a turn whose role may be chosen, which is never system.
_CHOSEN = {0: 2, 1: 2, 2: 3, 3: 2}
#: Turns inserted at the end of a conversation.
_TRAIL = {0: "", 1: "II", 2: "I", 3: ""}
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
_NEVER = (1 << 60, "")


class Solver:
    """Cheapest edits of signatures; what follows a turn is solved once for all signatures that end alike."""

    def __init__(self):
        self.memo: dict[tuple[str, int, int], tuple[int, str]] = {}

    def best(self, rest: str, state: int, goal: int) -> tuple[int, str]:
        """(cost, audit) from a state over the turns `rest` to `goal`; goal -1 is any end of a conversation."""
        found = self.memo.get((rest, state, goal))
        if found is None:
            found = self.memo[rest, state, goal] = self._edits(rest, state, goal)
        return found

    def _edits(self, rest: str, state: int, goal: int) -> tuple[int, str]:
        if not rest:
            return (INSERT * len(_TRAIL[state]), _TRAIL[state]) if goal < 0 else (0, "") if state == goal else _NEVER
        turn, rest, options = rest[0], rest[1:], []
        own, late = turn.lower(), int(turn.isupper())
        # two turns inserted before another lead back to the same choice, so one is enough
        for cost, lead, at in ((0, "", state), (INSERT, "I", _CHOSEN[state])):
            edits = [(DELETE, "D", at)]
            if turn != "x":
                edits.append((REROLE + late, "R", _CHOSEN[at]))
                if own in _AFTER[at]:
                    edits.append((KEEP + late, "K", _AFTER[at][own]))
            for price, name, after in edits:
                more, audit = self.best(rest, after, goal)
                options.append((cost + price + more, lead + name + audit))
        return min(options)

    def solve(self, signature: str, whole: bool) -> list[tuple[int, int, int, str]]:
        """(start, end, cost, audit): of a whole conversation (end -1), or of a block from each state to each."""
        if len(self.memo) > MEMO or len(signature) > MEMO_TURNS:
            self.memo.clear()
        goals = (-1,) if whole else range(4)
        for k in range(len(signature), -1, -1):  # from the end, so that no recursion goes deeper than a turn
            for state in range(4):
                for goal in goals:
                    self.best(signature[k:], state, goal)
        found = [(start, goal, *self.best(signature, start, goal)) for start in ((0,) if whole else range(4)) for goal in goals]
        if len(signature) > MEMO_TURNS:
            self.memo.clear()
        return [x for x in found if x[2] < _NEVER[0]]


_TABLE = "array<struct<start:int,end:int,cost:bigint,audit:string,rank:int>>"


def solutions(signatures: DataFrame) -> DataFrame:
    """(signature, whole, found) of distinct signatures; `rank` orders the audits of one start, which ties need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        for batch in batches:
            out = []
            for signature, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = solver.solve(signature, whole)
                order = {audit: k for k, audit in enumerate(sorted({x[3] for x in rows}))}
                out.append([{"start": a, "end": b, "cost": c, "audit": d, "rank": order[d]} for a, b, c, d in rows])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("rank", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["signature", "whole", "found"])

    return signatures.select("signature", "whole").distinct().mapInArrow(run, f"signature string, whole boolean, found {_TABLE}")


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(turns[c].cast("string"), F.lit(" ")) for c in (role_col, text_col))
    return turns.select(turns[conv_col].alias("conv"), turns[turn_col].try_cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.octet_length(text) + F.octet_length(role) + TURN_BYTES).cast("long").alias("weight"))


def _ordered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, at, seen): bytes before each turn, and whether it repeats an earlier one; a conversation is a task's."""
    conv = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum("weight").over(conv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    again = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("at")) > 1
    return rows.withColumn("at", before).select("conv", "turn", "role", "text", "at", again.alias("seen"))


def _spread(rows: DataFrame) -> DataFrame:
    """The same for conversations of any size: sums in two levels, over ranges of turns and inside them."""
    once = rows.groupBy("conv", "turn", "role", "text", "weight").agg(F.count("*").alias("n"))
    # written, so that all that follows sees the same ranges
    ranged = written(once.repartitionByRange("conv", "turn", "role", F.left(F.col("text"), F.lit(KEY_CHARS))).withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("conv", "range").agg(F.sum(F.col("weight") * F.col("n")).alias("weight"))
    before = F.sum("weight").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("conv").alias("c"), F.col("range").alias("r"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv", "range").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("prior", F.coalesce(F.sum(F.col("weight") * F.col("n")).over(inside), F.lit(0)))
    placed = placed.join(sums, F.col("conv").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))).withColumn("at", F.col("before") + F.col("prior")).select("conv", "turn", "role", "text", "weight", "n", "at")
    first = placed.groupBy("conv", "role", "text").agg(F.min("at").alias("f")).select(F.col("conv").alias("c"), "f")
    placed = placed.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("f")), "left").drop("c")
    # equal turns stand one after another; their numbers come in two steps, as arrays of all might be large
    zero, step = F.lit(0).cast("long"), 10_000
    placed = placed.withColumn("k", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / step))))
    placed = placed.withColumn("k", F.explode(F.sequence(F.col("k") * step, F.least(F.col("k") * step + step, "n") - 1)))
    return placed.select("conv", "turn", "role", "text", (F.col("at") + F.col("k") * F.col("weight")).alias("at"), (F.col("f").isNull() | (F.col("k") > 0)).alias("seen"))


def _marked(placed: DataFrame) -> DataFrame:
    """Faults, initials and letters of the signature."""
    fault = F.when(~F.col("text").rlike(_BLANK), "b").when(F.col("seen"), "d").when(~F.col("text").rlike(_ENDED), "t").otherwise("-")
    initial = F.left(F.col("role"), F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    return placed.withColumn("fault", fault).withColumn("initial", initial).withColumn("letter", letter)


def blocks(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_bytes: int = BLOCK_BYTES, whole_bytes: int = WHOLE_BYTES, paths: list[str] | None = None) -> DataFrame:
    """(conv, block, turns, signature, faults and turn numbers of the block), written to the shared folder.

    Turns stand by turn (null first), role and text.  See `repair` for the cases.
    """
    rows = _rows(turns, conv_col, turn_col, role_col, text_col)
    large = written(rows.groupBy("conv").agg(F.sum("weight").alias("n")).filter(F.col("n") > whole_bytes).select(F.col("conv").alias("c")), paths)
    if large.isEmpty():
        placed = _ordered(rows)
    else:
        same = F.col("conv").eqNullSafe(F.col("c"))
        placed = _ordered(rows.join(large, same, "left_anti")).unionByName(_spread(rows.join(large, same, "left_semi")))
    count = lambda fault: F.sum(F.when(F.col("fault") == fault, 1).otherwise(0)).cast("long")
    own = F.array_sort(F.collect_list(F.struct("at", "turn", "role", "text", "initial", "letter")))
    found = _marked(placed).groupBy("conv", F.floor(F.col("at") / block_bytes).alias("block")).agg(
        own.alias("turns"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"), F.min("turn").alias("least"), F.max("turn").alias("most")
    )
    initials = F.array_join(F.col("turns.initial"), "")
    legal = F.regexp_count(initials, F.lit("(?=su|ua|au)")).cast("long")
    return written(found.select(
        "conv", "block", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), F.array_join(F.col("turns.letter"), "").alias("signature"),
        "blank", "duplicate", "truncated", "least", "most", F.size(F.array_distinct(F.filter(F.col("turns.turn"), lambda t: t.isNotNull()))).cast("long").alias("n_numbers"),
        (F.size("turns") - 1 - legal).alias("illegal"), F.left(initials, F.lit(1)).alias("first"), F.right(initials, F.lit(1)).alias("last"),
    ), paths)


def _chained(parts: DataFrame) -> DataFrame:
    """(conv, block, start, end, audit, cost) of each block of long conversations, from all its solutions.

    Backwards over the blocks' numbers, a few for each, then forwards; ties by the order of audits.
    """
    light = parts.select("conv", F.struct("block", F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["cost"].alias("cost"), x["rank"].alias("rank"))).alias("found")).alias("x"))
    gathered = light.groupBy("conv").agg(F.array_sort(F.collect_list("x")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chain = batch.column(1)[k].as_py()
                after = {q: INSERT * len(t) for q, t in _TRAIL.items()}
                choice = []
                for part in reversed(chain):
                    best: dict[int, tuple] = {}
                    for x in part["found"]:
                        option = (x["cost"] + after.get(x["end"], _NEVER[0]), x["rank"], x["end"])
                        if option[0] < _NEVER[0]:
                            best[x["start"]] = min(best.get(x["start"], option), option)
                    choice.append(best)
                    after = {p: b[0] for p, b in best.items()}
                starts, state = [], 0
                for best in reversed(choice):
                    starts.append(state)
                    state = best[state][2]
                ends = [*starts[1:], state]
                n = len(chain)
                conv = pa.array([0] * n).cast(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1).take(conv), pa.array([p["block"] for p in chain], pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array([""] * (n - 1) + [_TRAIL[state]])],
                    names=["conv", "block", "start", "end", "trail"],
                )

    kind = parts.schema["conv"].dataType.simpleString()
    states = gathered.mapInArrow(run, f"conv {kind}, block bigint, start int, end int, trail string").withColumnsRenamed({"conv": "c", "block": "b"})
    met = parts.join(states, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    one = F.get(F.filter("found", lambda x: (x["start"] == F.col("start")) & (x["end"] == F.col("end"))), F.lit(0))
    return met.select("conv", "block", "start", F.concat(one["audit"], F.col("trail")).alias("audit"), (one["cost"] + INSERT * F.length("trail")).alias("cost"))


def _audited(found: DataFrame) -> list[DataFrame]:
    """Blocks with `start`, `audit` and `cost`: those of conversations of one block, then, if there are any, those of longer ones."""
    more = written(found.filter("block > 0").select(F.col("conv").alias("c")).distinct())
    if more.isEmpty():
        short, long = found, None
    else:
        same = F.col("conv").eqNullSafe(F.col("c"))
        short, long = found.join(more, same, "left_anti"), found.join(more, same, "left_semi")
    solved = solutions(short.select("signature", F.lit(True).alias("whole")))
    one = F.get("found", F.lit(0))
    out = [short.join(solved.select("signature", one["audit"].alias("audit"), one["cost"].alias("cost")), "signature").withColumn("start", F.lit(0))]
    if long is not None:
        solved = solutions(long.select("signature", F.lit(False).alias("whole"))).select("signature", "found")
        parts = written(long.select("conv", "block", "signature").join(solved, "signature"))
        chained = _chained(parts).withColumnsRenamed({"conv": "c", "block": "b"})
        out.append(long.join(chained, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b").select(out[0].columns))
    return out


def _replayed(audited: DataFrame) -> DataFrame:
    """Blocks with `repaired` (role, text) in place of `turns`: the edits of all audits of a batch at once."""
    rest = [c for c in audited.columns if c not in ("turns", "audit", "start", "signature")]
    source = audited.select("turns", "audit", "start", *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(0)
            inner = turns.flatten()
            audits = [a.encode() for a in batch.column(1).to_pylist()]
            edits = np.frombuffer(b"".join(audits), np.uint8)
            block = np.repeat(np.arange(len(audits)), [len(a) for a in audits])
            source_row = np.where(edits != ord("I"), np.cumsum(edits != ord("I")) - 1, -1)  # every other edit is of the next turn
            kept = np.flatnonzero(edits != ord("D"))
            row, own, block = source_row[kept], edits[kept] == ord("K"), block[kept]
            counts = np.bincount(block, minlength=len(audits))
            ordinal = np.arange(len(kept)) - np.repeat(np.cumsum(counts) - counts, counts)
            roles = inner.field(0).take(pa.array(np.maximum(row, 0))) if len(inner) else pa.array([], pa.string())
            start = np.asarray(batch.column(2))
            system = np.zeros(len(audits), bool)
            first = np.flatnonzero((ordinal == 0) & own & (start[block] == 0))
            system[block[first]] = [str(roles[k])[:1] == "s" for k in first.tolist()]
            odd = (ordinal - system[block] + (start[block] == 2)) % 2 == 1
            chosen = pa.array(np.where(odd, "assistant", "user"), pa.string())
            roles = pc.if_else(pa.array(own), roles, chosen)
            texts = inner.field(1).take(pa.array(row, mask=row < 0)).fill_null("") if len(inner) else pa.array([""] * len(kept))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            repaired = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([roles, texts], names=["role", "text"]))
            yield pa.RecordBatch.from_arrays([repaired, batch.column(1), *batch.columns[3:]], names=["repaired", "audit", *rest])

    kinds = ", ".join(f"`{c}` {audited.schema[c].dataType.simpleString()}" for c in rest)
    return source.mapInArrow(run, f"repaired array<struct<role:string,text:string>>, audit string, {kinds}")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_bytes: int = BLOCK_BYTES, whole_bytes: int = WHOLE_BYTES) -> list[DataFrame]:
    """Repaired conversations, in blocks: conv, block, repaired (role, text), audit, cost, and counts of faults.

    One DataFrame of conversations of one block, and one of longer ones if there are any.  The cheapest
    edits give roles whose initials are (s?(ua)+)?; ties go to the audit that comes first in ASCII.

    Null texts and roles are one space, so such texts are blank; turns that aren't whole numbers are null
    and come first; rows with a null conversation are one conversation; an empty role can't be kept.  Equal turn numbers stand by role
    and text; repeated rows are duplicates.  A very long text is a block of its own.  An empty table
    gives no blocks; other columns don't matter, whatever their names.
    """
    found = blocks(turns, conv_col, turn_col, role_col, text_col, block_bytes, whole_bytes)
    return [_replayed(part) for part in _audited(found)]


def damaged(turns: DataFrame) -> DataFrame:
    """The rows that query op11 repairs: each is dropped, emptied, cut, repeated or given a role by the hash of its place."""
    kept = {c: F.coalesce(turns[c].cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    rule = (F.crc32(F.concat(kept["conv_id"], F.lit(":"), kept["turn"]).cast("binary")) % 20).cast("int")
    rows = turns.select("conv_id", "turn", kept["role"].alias("role"), kept["text"].alias("text"), rule.alias("rule")).filter("rule <> 0")
    text = F.when(F.col("rule") == 1, "").when(F.col("rule") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("rule") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("rule") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("copy", "times")


def _lines() -> Column:
    return F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def _long_digests(found: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) of long conversations: blocks in order pass through one digest, whatever their number."""
    source = found.select("conv", "block", "audit", _lines().alias("text"), (F.size("repaired") > 0).alias("some")).repartition("conv").sortWithinPartitions("conv", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, any_, conv = None, [], False, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([conv, pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv", "audit", "repaired_sha256"])

        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(1)[k].as_py() == 0:  # each conversation begins with block 0
                    if digest is not None:
                        yield out()
                    digest, audit, any_, conv = hashlib.sha256(), [], False, batch.column(0).slice(k, 1)
                if batch.column(4)[k].as_py():
                    digest.update((b"\n" if any_ else b"") + batch.column(3)[k].as_py().encode())
                    any_ = True
                audit.append(batch.column(2)[k].as_py())
        if digest is not None:
            yield out()

    return source.mapInArrow(run, f"conv {found.schema['conv'].dataType.simpleString()}, audit string, repaired_sha256 string")


def _gaps(most: Column, least: Column, n: Column) -> Column:
    return F.when(most.isNull(), F.lit(0)).otherwise(F.try_subtract(F.try_add(F.try_subtract(most, least), F.lit(1)), n))


def summaries(turns: DataFrame, block_bytes: int = BLOCK_BYTES, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """A row per conversation that has rows: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Gaps are null only where turn numbers lie further apart than a long can say.
    """
    parts = repair(turns, block_bytes=block_bytes, whole_bytes=whole_bytes)
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    short = parts[0].withColumn("gaps", _gaps(F.col("most"), F.col("least"), F.col("n_numbers"))).withColumn("repaired_sha256", F.sha2(_lines().cast("binary"), 256)).select(names)
    if len(parts) == 1:
        return short
    parts = [short, written(parts[1])]
    order = Window.partitionBy("conv").orderBy("block")
    pair = F.concat(F.lag("last").over(order), F.col("first"))
    light = parts[1].drop("repaired", "audit").withColumn("more", F.when(pair.isNull() | pair.isin("su", "ua", "au"), 0).otherwise(1)).withColumn("shared", F.when(F.max("most").over(order.rowsBetween(Window.unboundedPreceding, -1)) == F.col("least"), 1).otherwise(0))
    sums = light.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")], (F.sum("illegal") + F.sum("more")).alias("illegal"), _gaps(F.max("most"), F.min("least"), F.sum("n_numbers") - F.sum("shared")).alias("gaps"))
    digests = _long_digests(parts[1]).withColumnRenamed("conv", "c")
    return reduce(DataFrame.unionByName, [short, sums.join(digests, F.col("conv").eqNullSafe(F.col("c"))).select(names)])


def report(turns: DataFrame) -> DataFrame:
    """The columns of query op11: every conversation of the table after damage and repair."""
    every = turns.select("conv_id").distinct()
    found = summaries(damaged(turns))
    met = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.when(F.col("audit").isNull(), F.lit(0))).cast("long").alias(c)
    numbers = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))

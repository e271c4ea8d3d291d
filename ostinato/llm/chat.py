"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens deal a conversation to turn-aligned spans of bounded size.  A window
is the system turn, a limited tail of the span before (both repeated, without loss), and the
span itself, whose assistant texts are the targets: each is a target in exactly one window.

Conversations are dealt to tasks whole, in one shuffle of their texts: windows, tails and system
turns are then found without another one.  Those of more than `WHOLE_TURNS` turns or `WHOLE_BYTES`
bytes, as a first small aggregation tells, are spread instead: their prefix sums are taken in two
levels, over ranges of turns and inside them, and later groups are windows.  Both ways give the same windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A conversation of at most so many turns and bytes of text is one task's work.
WHOLE_TURNS, WHOLE_BYTES = 10_000, 8 << 20
#: Ranges of turns are cut by so much of a role or text, so that what is sampled for them stays small.
KEY_CHARS = 64
BEGIN, OPEN, MID, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(/?(?:s>|INST\]))"
#: Words, digits and other signs count as a token each; every turn has four more.
TOKEN = "[\\p{L}\\p{M}]+|\\p{N}|[^ \t\n\r\f\x0b\\p{L}\\p{M}\\p{N}]"
TURN_TOKENS = 4


def escape(text: Column) -> Column:
    """Double every backslash, then put one inside each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long") + TURN_TOKENS


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(turns[text_col].cast("string"), F.lit(""))
    return turns.select(
        turns[conv_col].alias("conv"), F.coalesce(turns[turn_col].cast("long"), F.lit(-(2**63))).alias("turn"),
        F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"), text.alias("text"), tokens(text).alias("tok"),
    )


def _room(budget: int, history: int) -> Column:
    """Tokens that a span may start in: half of what history and the system turn leave."""
    return F.greatest(F.floor((F.lit(budget - history) - F.coalesce("system_tok", F.lit(0))) / 2), F.lit(budget // 8)).cast("long")


_TURN = ("start", "role", "text", "tok")


def _spans(placed: DataFrame, history: int) -> DataFrame:
    """(conv, own, begin, end, tail): turns of each span, and those at its end that the next window repeats."""
    spans = placed.groupBy("conv", F.floor(F.col("start") / F.col("room")).alias("bucket"), (F.col("tok") > F.col("room")).alias("large")).agg(F.array_sort(F.collect_list(F.struct(*_TURN))).alias("own"))
    last = F.element_at("own", -1)
    spans = spans.select("conv", "own", F.element_at("own", 1)["start"].alias("begin"), (last["start"] + last["tok"]).alias("end"))
    return spans.withColumn("tail", F.filter("own", lambda t: (t["start"] >= F.col("end") - history) & (t["role"] != "system")))


def _whole(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv, at, own, tail, system) of conversations that each are in one task; only the first window moves texts."""
    conv = Window.partitionBy("conv")
    before = F.sum("tok").over(conv.orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.select("conv", F.coalesce(before, F.lit(0)).alias("start"), "role", "text", "tok")
    first = F.min(F.when(F.col("role") == "system", F.struct("start", "tok"))).over(conv)
    spans = _spans(placed.withColumn("system_tok", first["tok"]).withColumn("room", _room(budget, history)), history)
    system = F.min(F.get(F.filter("own", lambda t: t["role"] == "system"), F.lit(0))).over(conv)
    met = spans.select("conv", F.col("begin").alias("at"), "own", F.lag("tail").over(conv.orderBy("begin")).alias("tail"), system.alias("system"))
    return met.withColumn("system", F.when(F.col("system.start") < F.col("at"), F.col("system")))


def _spread(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """The same of conversations of any size: no task holds more than a range of turns or a window."""
    once = rows.groupBy("conv", "turn", "role", "text", "tok").agg(F.count("*").alias("n"))
    # of roles that are cut the text isn't looked at, so that all that begin alike share a range
    key = F.when(F.length("role") < KEY_CHARS, F.left(F.col("text"), F.lit(KEY_CHARS)))
    # written, so that all that follows sees the same ranges
    ranged = written(once.repartitionByRange("conv", "turn", F.left(F.col("role"), F.lit(KEY_CHARS)), key).withColumn("block", F.spark_partition_id()))
    sizes = ranged.groupBy("conv", "block").agg(F.sum(F.col("tok") * F.col("n")).alias("tok"), F.min(F.when(F.col("role") == "system", F.struct("turn", "text", "tok"))).alias("system"))
    sizes = sizes.withColumn("system", F.when(F.col("system").isNotNull(), F.struct("block", F.col("system.tok").alias("tok"))))
    whole = Window.partitionBy("conv")
    before = F.coalesce(F.sum("tok").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("conv").alias("c"), F.col("block").alias("b"), before.alias("before"), F.min("system").over(whole)["tok"].alias("system_tok"))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("prior", F.coalesce(F.sum(F.col("tok") * F.col("n")).over(inside), F.lit(0)))
    placed = summed.join(sizes, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).withColumn("room", _room(budget, history))
    # equal turns stand one after another; their numbers come in two steps, as arrays of all might be large
    zero, step = F.lit(0).cast("long"), 10_000
    placed = placed.withColumn("k", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / step))))
    placed = placed.withColumn("k", F.explode(F.sequence(F.col("k") * step, F.least(F.col("k") * step + step, "n") - 1)))
    placed = placed.select("conv", (F.col("before") + F.col("prior") + F.col("k") * F.col("tok")).alias("start"), "role", "text", "tok", "room")
    spans = _spans(placed, history)
    kind = spans.schema["own"].dataType
    ends = F.array(F.struct(F.col("begin").alias("at"), F.col("own").alias("own"), F.lit(None).cast(kind).alias("tail")), F.struct(F.col("end").alias("at"), F.lit(None).cast(kind).alias("own"), F.col("tail").alias("tail")))
    both = spans.select("conv", F.explode(ends).alias("x"))
    # a span's tail meets the span that begins where it ends
    met = both.groupBy("conv", F.col("x.at").alias("at")).agg(F.first("x.own", True).alias("own"), F.first("x.tail", True).alias("tail")).filter("own IS NOT NULL")
    system = placed.filter("role = 'system'").groupBy("conv").agg(F.min(F.struct(*_TURN)).alias("system")).select(F.col("conv").alias("c"), "system")
    return met.join(system, F.col("conv").eqNullSafe(F.col("c")) & (F.col("system.start") < F.col("at")), "left").drop("c")


def _formatted(met: DataFrame, conv_col: str, budget: int) -> DataFrame:
    """The windows of (conv, at, own, tail, system)."""
    empty = F.array().cast(met.schema["own"].dataType)
    repeated = F.concat(F.when(F.col("system").isNotNull(), F.array("system")).otherwise(empty), F.coalesce("tail", empty))
    met = met.select("conv", "at", F.size(repeated).alias("n"), F.concat(repeated, "own").alias("turns"))
    piece = lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MID)).alias("head"), escape(t["text"]).alias("body"), t["role"].alias("role"), t["tok"].alias("tok"))
    met = met.withColumn("pieces", F.transform("turns", piece)).drop("turns")
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)
    lead = F.aggregate(F.slice("pieces", 1, F.col("n")), F.lit(len(BEGIN)).cast("long"), lambda a, p: a + size(p))
    start = F.struct(lead.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + F.length(p["head"])
        own = F.array(F.struct(begin.alias("start"), (begin + F.length(p["body"])).alias("end")))
        return F.struct((a["at"] + size(p)).alias("at"), F.when(p["role"] == "assistant", F.concat(a["spans"], own)).otherwise(a["spans"]).alias("spans"))

    loss = F.aggregate(F.slice("pieces", F.col("n") + 1, F.greatest(F.size("pieces") - F.col("n"), F.lit(0))), start, step, lambda a: a["spans"])
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""))
    used = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["tok"])
    return met.select(
        F.col("conv").alias(conv_col), F.col("at").alias("window_start"), text.alias("formatted"), F.col("n").alias("n_repeated"),
        loss.alias("loss_spans"), used.alias("n_tokens"), (used > budget).alias("over_budget"),
    )


def _parts(rows: DataFrame, budget: int, history: int, whole_turns: int, whole_bytes: int) -> list[DataFrame]:
    """Conversations that fit a task, and, if there are any, those that don't."""
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("n_bytes"))
    large = written(sizes.filter((F.col("n") > whole_turns) | (F.col("n_bytes") > whole_bytes)).select(F.col("conv").alias("c")))
    if large.isEmpty():
        return [_whole(rows, budget, history)]
    same = F.col("conv").eqNullSafe(F.col("c"))
    return [_whole(rows.join(large, same, "left_anti"), budget, history), _spread(rows.join(large, same, "left_semi"), budget, history)]


def windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 1024, history: int = 256, whole_turns: int = WHOLE_TURNS, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """A row per window: conv_col, window_start, formatted, n_repeated, loss_spans, n_tokens, over_budget.

    Turns stand in the order of turn (null first), role and text; repeated rows are turns of their
    own.  Null texts and roles are empty, null conversations are one.  `n_repeated` is the number
    of leading turns that other windows own; `loss_spans` are (start, end) in code points of
    `formatted`.  A window holds at most `budget` tokens, unless a single turn, or the system turn,
    is too long for that: it stays whole, and `over_budget` marks the window.  Very long texts are
    turns like others; an empty table gives no windows; other columns don't matter.
    """
    parts = _parts(_rows(turns, conv_col, turn_col, role_col, text_col), budget, history, whole_turns, whole_bytes)
    return reduce(DataFrame.unionByName, (_formatted(part, conv_col, budget) for part in parts))


def read_back(found: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What windows hold: conv_col, window_start, turns (role, text) that the window owns, loss_text (texts under the mask), n_chars."""
    parts = F.split(F.substring("formatted", len(BEGIN) + 1, 2**31 - 1), CLOSE)
    own = F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.size(parts) - 1 - F.col("n_repeated"), F.lit(0)))
    role = lambda p: unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2**31 - 1), MID, 1))
    text = lambda p: unescape(F.substring_index(p, MID, -1))
    spans = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return found.select(conv_col, "window_start", F.transform(own, lambda p: F.struct(role(p).alias("role"), text(p).alias("text"))).alias("turns"), F.array_join(spans, "").alias("loss_text"), F.length("formatted").cast("long").alias("n_chars"))


def _digests(found: DataFrame) -> DataFrame:
    row = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = found.select("conv_id", F.struct("window_start", row.alias("turns"), "loss_text").alias("w"), F.size("turns").cast("long").alias("n"), "n_chars")
    whole = per.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("w", lambda x: x["loss_text"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["turns"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def report(turns: DataFrame) -> DataFrame:
    """The columns of query op10, read back from the windows.

    A digest is of one whole conversation, so only here its windows meet in one row.
    """
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    more = turns.sparkSession.range(2, numPartitions=1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    rows = _rows(turns.select("conv_id", "turn", "role", "text").unionByName(more), "conv_id", "turn", "role", "text")
    parts = _parts(rows, 1024, 256, WHOLE_TURNS, WHOLE_BYTES)
    return reduce(DataFrame.unionByName, (_digests(read_back(_formatted(part, "conv_id", 1024))) for part in parts))

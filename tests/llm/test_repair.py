import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from ostinato.llm import queries, repair

SHAPE = "conv_id long, turn long, role string, text string, conv string, block int, turns string, audit string"


def plain(rows):
    """(cost, audit, repaired lines) of sorted (role, text, fault) rows, by trying every way to edit them."""
    best = None
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    choices = []
    for role, text, fault in rows:
        late = int(fault == "t")
        own = [("D", 3, None)]
        if fault not in "bd":
            own += [("K", late, (role, text)), ("R", 2 + late, ("user", text)), ("R", 2 + late, ("assistant", text))]
        choices.append(own)
    for edits in itertools.product(*choices):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            audit, cost, out = "", 0, []
            for k in range(len(rows) + 1):
                audit, cost = audit + "I" * len(added[k]), cost + 2 * len(added[k])
                out += [(r, "") for r in added[k]]
                if k < len(rows):
                    audit, cost = audit + edits[k][0], cost + edits[k][1]
                    out += [edits[k][2]] if edits[k][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best or (0, "", "")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        rest = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "b" if not rest else "d" if (role, text) in seen else "t" if rest[-1] not in ".!?" else "-"))
        seen.add((role, text))
    return out


def conversations(n, most, seed):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(r.randint(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, r.choice([None, 0, 1, 2, 3, 4, 9]), role, r.choice(["Yes.", "no", "why? \n", " \t", None, "", "ok!", "é…", "x" * 30]), "c", 1, "t", "a"))
    return rows


def want(rows):
    out = {}
    key = lambda x: (x[1] is not None, x[1] or 0, x[2].encode(), x[3].encode())
    for conv in {r[0] for r in rows}:
        own = sorted(((c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text, *_ in rows if c == conv), key=key)
        own_faults = faults([(role, text) for _, _, role, text in own])
        cost, audit, lines = plain(own_faults)
        numbers = [t for _, t, *_ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        odd = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        count = [sum(f == x for *_, f in own_faults) for x in "bdt"]
        out[conv] = (gaps, *count, odd, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def test_repairs_equal_all_ways_tried(spark):
    rows = conversations(60, 3, 1)
    got = {tuple(r)[0]: tuple(r)[1:] for r in repair.summaries(spark.createDataFrame(rows, SHAPE).repartition(3)).collect()}
    assert got == want(rows)


def test_long_conversations_equal_short_ones(spark):
    """Blocks of a few turns, chained, and turns put in order by several tasks, give what whole conversations give."""
    rows = conversations(40, 30, 2) + [(3, 5, "user", "again.", "c", 1, "t", "a")] * 40
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    whole = sorted(repair.summaries(df).collect(), key=str)
    assert max(len(r.audit) for r in whole) > 40
    for block, most in ((3 * repair.TURN_BYTES, repair.WHOLE_BYTES), (5 * repair.TURN_BYTES, 8 * repair.TURN_BYTES), (1, 1)):
        assert sorted(repair.summaries(df, block, most).collect(), key=str) == whole


def test_damage_follows_the_rule(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!", "c", 1, "t", "a") for c in range(30) for t in range(6)] + [(None, None, None, None, "c", 1, "t", "a")]
    got = sorted(map(str, repair.damaged(spark.createDataFrame(rows, SHAPE)).select("conv_id", "turn", "role", "text").collect()))
    expected = []
    for c, t, role, text, *_ in rows:
        show = lambda x: " " if x is None else str(x)
        rule = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", show(text))}.get(rule, show(text))
        expected += [(c, t, "user" if rule == 4 else show(role), text)] * {0: 0, 3: 2}.get(rule, 1)
    assert got == sorted(f"Row(conv_id={c}, turn={t}, role={role!r}, text={text!r})" for c, t, role, text in expected)


def test_odd_and_empty_tables(spark):
    long = "word " * 400_000 + "end."
    rows = [(1, 0, "system", long, "c", 1, "t", "a"), (1, 1, "user", long, "c", 1, "t", "a"), (1, 1, "user", long, "c", 1, "t", "a"), (2, None, None, None, None, None, None, None), (-1, 2**62, "user", "a.", "c", 1, "t", "a"), (-1, -(2**62) * 2, "assistant", "b.", "c", 1, "t", "a")]
    df = spark.createDataFrame(rows, SHAPE)
    got = {r.conv: r for r in repair.summaries(df).collect()}
    assert got[1].audit == "KKDI" and (got[1].cost, got[1].duplicate) == (5, 1) and got[2].audit == "D" and got[2].gaps == 0
    assert got[-1].gaps is None and got[-1].audit == "IKKI"
    assert repair.report(df.filter("1 = 0")).count() == 0 and repair.summaries(df.filter("1 = 0")).count() == 0
    assert {r.conv_id for r in repair.report(df).collect()} == {1, 2, -1}
    dropped = spark.createDataFrame([(c, t, "user", "x") for c in range(400) for t in [0]], "conv_id long, turn long, role string, text string")
    gone = [r for r in repair.report(dropped).collect() if r.audit == ""]
    assert gone and all(r.repaired_sha256 == hashlib.sha256(b"").hexdigest() and r.cost == r.blank == r.gaps == 0 for r in gone)


def test_each_signature_is_solved_once(spark):
    df = spark.range(500).selectExpr("id % 50 AS conv_id", "id DIV 50 AS turn", "IF(id DIV 50 % 2 = 0, 'user', 'assistant') AS role", "concat('t', id, '.') AS text")
    found = repair.blocks(df)
    assert found.select("signature").distinct().count() == 1
    assert repair.solutions(found.select("signature", F.lit(True).alias("whole"))).count() == 1
    assert {r.audit for r in repair.summaries(df).collect()} == {"K" * 10}


def test_query_gives_every_conversation(spark):
    docs = queries.read(spark, "/root/testdata/sf0.01", "conversations")
    assert queries.op11_repair(spark, "/root/testdata/sf0.01").count() == docs.select("conv_id").distinct().count()

"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from regionwatch.llm import repair

FULL = {"u": "user", "a": "assistant"}
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        convs[conv] += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return convs


def cheapest(rows, faults):
    """Least (cost, audit) over every edit of every row, from the last row back; and the repaired lines."""

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def way(then, cost, letter, line=()):
            if then:
                ways.append((cost + then[0], letter + then[1], line + then[2]))

        for r in "ua":
            if inserted < 3 and (state, r) in STEP:
                way(best(i, STEP[state, r], inserted + 1), 2, "I", (f"{FULL[r]}:",))
        if i < len(rows):
            _, role, text = rows[i]
            way(best(i + 1, state, 0), 3, "D")
            if faults[i] not in "bd":
                extra = int(faults[i] == "t")
                if (state, role[:1]) in STEP:
                    way(best(i + 1, STEP[state, role[:1]], 0), extra, "K", (f"{role}:{text}",))
                for r in "ua":
                    if (state, r) in STEP:
                        way(best(i + 1, STEP[state, r], 0), extra + 2, "R", (f"{FULL[r]}:{text}",))
        return min(ways, key=lambda w: w[:2], default=None)

    for i in range(len(rows), 0, -1):  # rows behind first, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def plain(convs):
    out = {}
    for conv, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not shown else "d" if (role, text) in seen else "-" if shown[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = cheapest(rows, faults)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


def solved(frame, block=repair.BLOCK):
    rows = repair.repair(frame, block).collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_table_after_damage(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = plain(damaged(map(tuple, table.select("conv_id", "turn", "role", "text").collect())))
    assert solved(repair.damaged(table)) == want


@pytest.mark.parametrize("block", [3, repair.BLOCK])
def test_random_conversations_with_ties_nulls_and_strange_roles(spark, block):
    rng = random.Random(4)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"], ["a.", "b", "c!", "", None, " \t", "d?", "e", "f. ", "é."]
    rows = [(c if c else None, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randrange(1, 14))]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("clash") for n in ("key", "copies", "kind", "fault", "part", "audit")})
    assert solved(repair.damaged(frame), block) == plain(damaged(rows))


def test_long_conversation_lies_in_many_tasks(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"text {rng.randrange(400)}{rng.choice('.!?,')}") for t in range(700)]
    rows += [(c, t, "user", "x.") for c in range(3) for t in range(2)]
    found = repair.stretches(repair.symbols(repair.damaged(spark.createDataFrame(rows, SCHEMA))), 50)
    assert found.where("conv_id = 7").select("part").distinct().count() > 1
    assert solved(repair.damaged(spark.createDataFrame(rows, SCHEMA)), 50) == plain(damaged(rows))


def test_many_copies_of_one_row(spark):
    rows = [(1, 0, "user", "same.")] * 100 + [(1, 1, "assistant", "other.")]
    kept = repair.undamaged(spark.createDataFrame(rows, SCHEMA))
    want = plain({1: [r[1:] for r in rows]})
    assert solved(kept, 16) == want and want[1][6] == "K" + "D" * 99 + "K"


def test_rules_change_no_result():
    rng = random.Random(6)
    sequences = list({bytes(rng.choices(range(repair.SYMBOLS), k=rng.randrange(1, 30))) for _ in range(300)})
    grammar, bare = repair.Grammar(), repair.Grammar()
    short = repair.compressed(grammar, sequences)
    assert len(grammar.parts) > repair.SYMBOLS and sum(map(len, short)) < sum(map(len, sequences))
    for raw, symbols in zip(sequences, short):
        one, two = grammar.whole(symbols), bare.whole(list(raw))
        assert grammar.matrices[one].cost == bare.matrices[two].cost
        for a, b in grammar.matrices[one].cost:
            assert grammar.audit(one, a, b) == bare.audit(two, a, b)


def test_edits_of_a_conversation(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "tool", "t"), (2, 0, "user", "q.")]
    frame = repair.undamaged(spark.createDataFrame(rows, SCHEMA))
    found = repair.audits(frame)
    edits = sorted((r["conv_id"], r["place"], r["edit"], r["role"], r["text"]) for r in repair.edited_rows(frame, found).collect())
    assert edits == [(1, 0, "K", "system", "s."), (1, 1, "I", "user", ""), (1, 2, "K", "assistant", "a."), (1, 3, "D", "tool", "t"), (2, 0, "K", "user", "q."), (2, 1, "I", "assistant", "")]


def test_empty_table_and_conversations_that_lose_all_rows(spark):
    assert solved(repair.damaged(spark.createDataFrame([], SCHEMA))) == {}
    conv = next(c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = solved(repair.damaged(spark.createDataFrame([(conv, 0, "user", "gone.")], SCHEMA)))
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}

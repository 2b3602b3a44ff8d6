import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from duesight.llm import repair
from duesight.llm.queries import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(rows):
    """(cost, audit, repaired) by recursion over what is left; rows: (role, text, fault). Not by agenda, not by pieces."""
    def step(state, initial):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)

    @lru_cache(None)
    def rest(i, state, inserted):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        role = "assistant" if state == "u" else "user"
        if inserted < 3:
            c, a, out = rest(i, role[0], inserted + 1)
            options.append((c + 5, "I" + a, ((role, ""), *out)))
        if i < len(rows):
            own, text, fault = rows[i]
            c, a, out = rest(i + 1, state, 0)
            options.append((c + 2, "D" + a, out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                c, a, out = rest(i + 1, role[0], 0)
                options.append((c + 1 + more, "R" + a, ((role, text), *out)))
                kept = step(state, own[:1])
                if kept:
                    c, a, out = rest(i + 1, kept, 0)
                    options.append((c + more, "K" + a, ((own, text), *out)))
        return min(options, default=(10**9, "", ()), key=lambda o: o[:2])

    sys.setrecursionlimit(20_000)
    return rest(0, "", 0)


def brute_force(table):
    after, ids = {}, {}
    for conv, turn, role, text in table:
        ids[conv] = None
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        role = "user" if lot == 4 else role
        after.setdefault(conv, []).extend([(turn, role, text)] * (2 if lot == 3 else 1))
    out = []
    for conv in ids:
        rows = sorted(after.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0))
        turns = {r[0] for r in rows if r[0] is not None}
        faults, seen = [], set()
        for _, role, text in rows:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
        cost, audit, repaired = cheapest(tuple((r[1], r[2], f) for r, f in zip(rows, faults)))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"),
                    faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def ran(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def conversations(seed, n, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why? ", "So.\n", "again.", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    table = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, longest)):
            text = rng.choice(texts)
            table.append((conv, None if rng.random() < 0.05 else 2 * turn if conv and conv % 3 else turn, rng.choice(roles),
                          f"{text}{turn}." if rng.random() < 0.5 else text))
    # One row a turn, as the order within a turn is the operator's own.
    return list({(c, t): (c, t, r, x) for c, t, r, x in table}.values())


def test_against_recursion(spark):
    table = conversations(11, 300)
    wanted = brute_force(table)
    assert {"D", "K", "R"} <= set("".join(r[7] for r in wanted)) and any(r[7] == "" and r[6] == 0 for r in wanted)
    assert ran(repair.repair_report(spark.createDataFrame(table, SCHEMA).repartition(4))) == wanted


@pytest.mark.parametrize("piece", [1, 2, 5])
def test_pieces_give_the_same(spark, piece):
    """Conversations that spread over ranges and blocks, one of them with most of the rows."""
    table = conversations(5, 40) + [(999, t, ("user", "assistant")[t % 2 if t % 7 else 1], f"line {t // 2}.") for t in range(300)]
    assert ran(repair.repair_report(spark.createDataFrame(table, SCHEMA), piece)) == brute_force(table)


def test_ties_take_the_least_audit():
    assert repair.lightest([("t", repair.FINE)], repair.USER)[repair.USER] == (2, "D")
    assert repair.lightest([("a", repair.FINE)], repair.START)[repair.ASSISTANT] == (5, "IK")
    rows = [("u", repair.FINE), ("u", repair.FINE), ("a", repair.FINE)]
    assert repair.lightest(rows, repair.START)[repair.ASSISTANT] == (2, "DKK")
    assert repair.joined([[(a, b, c, t) for a in range(4) for b, (c, t) in repair.lightest([r], a).items()] for r in rows]) == (2, ["D", "K", "K"])


def test_the_given_table(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ran(op11_conversation_repair(spark, sf_dir)) == brute_force(table)


def test_repaired_rows(spark):
    table = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "user", "Hi?"), (1, 3, "tool", "Hello."), (2, 0, "user", ""), (3, 0, "user", "A."), (3, 1, "user", "B."), (3, 2, "user", "C.")]
    got = repair.repaired_turns(spark.createDataFrame(table, SCHEMA)).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in got if r["conv_id"] == 1] == [
        (1, 0, "K", "system", "Be kind."), (1, 1, "K", "user", "Hi?"), (1, 2, "R", "assistant", "Hello.")]
    assert not [r for r in got if r["conv_id"] == 2]
    assert [r["role"] for r in got if r["conv_id"] == 3] == ["user", "assistant"]


def test_odd_rows(spark):
    """Nulls everywhere, very long and repeated rows, clashing names, an empty table."""
    long = "word " * 200_000 + "."
    table = [(None, None, None, None), (1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", "A."), (2, 0, "user", "A."),
             (2, 0, "user", "A."), (1 << 60, 5, "assistant", "Ünïcode 日本語!")]
    frame = spark.createDataFrame([(*r, 1, 2, "k", "f", "e") for r in table],
                                  f"{SCHEMA}, part int, pos long, key string, fault string, edits string")
    assert ran(repair.repair_report(frame)) == brute_force(table)
    assert repair.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert repair.repaired_turns(spark.createDataFrame([], SCHEMA)).collect() == []

"""Repair of conversations against a version that looks at every way to repair."""

import hashlib
import random
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from lakeops.llm import QUERIES, conversations

SPACE = " \t\n\x0b\x0c\r"


def plain_rows(rows):
    """Damaged rows of each conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm == 0:
            continue
        if harm == 1:
            text = ""
        if harm == 2:
            text = "".join(c for c in text if c not in ".!?")
        if harm == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if harm == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def plain_repair(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, said, puts):
        """Cost and letters from row i on, after the roles ``said`` ("", "s", "u" or "a" last)."""
        ways = []
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[said]
        if i == len(rows) and said in ("", "a"):
            ways.append((0, "", ()))
        if puts < 2:
            for x in "ua":
                if x in fits:
                    c, s, o = best(i, x, puts + 1)
                    ways.append((c + 5, "I" + s, ((x, None), *o)))
        if i < len(rows):
            c, s, o = best(i + 1, said, 0)
            ways.append((c + 2, "D" + s, o))
            if faults[i] not in ("blank", "duplicate"):
                more, own = 5 * (faults[i] == "truncated"), rows[i][1][:1]
                if own and own in fits:
                    c, s, o = best(i + 1, own, 0)
                    ways.append((c + more, "K" + s, (("k", i), *o)))
                for x in "ua":
                    if x in fits:
                        c, s, o = best(i + 1, x, 0)
                        ways.append((c + more + 1, "R" + s, ((x, i), *o)))
        return min(ways, key=lambda w: w[:2], default=(10**9, "", ()))

    cost, audit, kept = best(0, "", 0)
    names = {"u": "user", "a": "assistant"}
    said = [f"{rows[i][1] if x == 'k' else names[x]}:{'' if i is None else rows[i][2]}" for x, i in kept]
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip([r[1][:1] for r in rows], [r[1][:1] for r in rows[1:]])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def compare(df, rows):
    sys.setrecursionlimit(20_000)
    assert df.columns == COLUMNS
    found = df.collect()
    got = {r.conv_id: tuple(r)[1:] for r in found}
    assert len(found) == len(got)
    want = {k: plain_repair(v) for k, v in plain_rows(rows).items()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == w, k
    return want


def test_query_is_the_plain_version_over_all_conversations(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(QUERIES["op12_conversation_repair"](spark, sf), rows)


def odd_rows(seed, conversations_, rows_each):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", " ", "", None, "What?", "ends here. \n", "over"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "agent", "User"]
    return [
        (c, None if rng.random() < 0.1 else rng.randrange(2 * rows_each), rng.choice(roles),
         t if (t := rng.choice(texts)) is None or rng.random() < 0.3 else f"{rng.randrange(99)} {t}")
        for c in [None, *range(conversations_)] for _ in range(rng.randrange(1, rows_each))]


@pytest.mark.parametrize("chunk", [8192, 3])
def test_odd_rows_in_chunks_of_any_size(spark, chunk):
    rows = odd_rows(5, 60, 14)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("b", F.lit("own")).withColumn("audit", F.lit(1))
    want = compare(conversations.repair(df.repartition(5), chunk=chunk), rows)
    assert any(w[0] for w in want.values()) and {x for w in want.values() for x in w[6]} == {"K", "R", "D"}


def test_a_conversation_of_many_chunks(spark):
    """One conversation holds nearly all rows, with long stretches of rows that are deleted or truncated."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{t} said" if 60 < t < 160 else "same." if 200 < t < 300 else f"{t}.") for t in range(400)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes."), (0, 0, "system", "Be kind.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    compare(conversations.repair(df.repartition(3), chunk=7), rows)


def test_vectors_that_arrive_late_are_walked_again():
    steps = conversations.Steps()
    rng = random.Random(1)
    for _ in range(300):
        symbols = "".join(rng.choice("suaxSUAX") for _ in range(rng.randrange(12)))
        ends = [conversations._plain(conversations._with_inserts([rng.randrange(9) for _ in range(4)])) for _ in range(2)]
        first = conversations.walk_back(steps, symbols, ends[0])[0]
        assert conversations.again_back(steps, symbols, ends[0], ends[1], first) == conversations.walk_back(steps, symbols, ends[1])[0]


def test_rows_put_in_are_cheapest_sometimes():
    """No row may be put in for less than a deletion, so letters are checked on vectors of our own."""
    steps = conversations.Steps()
    letters, put, row, state, cost = steps.choose("a", conversations._plain(conversations._with_inserts([40, 40, 40, 0])), conversations.START)
    assert (letters, put, row, state, cost) == ("IK", "u", "k", conversations.ASSISTANT, 5)


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversations.repair(df).collect() == []
    gone = next(t for t in range(99) if zlib.crc32(f"x:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([("x", gone, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    assert [tuple(r) for r in conversations.repair(df).collect()] == [("x", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]

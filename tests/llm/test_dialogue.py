"""Conversation repair against an exhaustive search that knows no grammar."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from samples import CLASHING

from tidemark.llm import dialogue

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
SPACE = " \t\n\v\f\r"


def table(spark, rows, extra=()):
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in extra])


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(faults, initials):
    """(cost, audit): least first through all edit sequences; the state is the row and what was kept last."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(faults) and state in ("", "a"):
            return cost, audit
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for role in "ua":
            if role in after:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role))
        if i < len(faults):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                if initials[i] in after and initials[i]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials[i]))
                for role in "ua":
                    if role in after:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, role))


def expected(rows, broken=True):
    """conv_id -> the query's other columns, in order."""
    after = damage(rows) if broken else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in own if r[1] is not None]
        faults = []
        for k, (_, _, role, text) in enumerate(own):
            bare = text.strip(SPACE)
            seen = any(r[2:] == (role, text) for r in own[:k])
            faults.append("blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else "")
        initials = [r[2][:1] for r in own]
        cost, audit = cheapest(faults, initials)
        kept, k = [], 0
        for edit in audit:
            row = None if edit == "I" else own[k]
            k += edit != "I"
            if edit == "K":
                kept.append((row[2], row[3]))
            elif edit in "RI":
                kept.append(("user" if not kept or kept[-1][0][0] in "sa" else "assistant", row[3] if row else ""))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in kept))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def found(df):
    rows = [tuple(r) for r in df.select("conv_id", *dialogue.FIGURES, "audit", "repaired_sha256").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def conversations(rng, n, most):
    rows = []
    for conv in range(n):
        turns = sorted(rng.sample(range(most * 2), rng.randrange(1, most + 1)))
        rows += [(conv, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rng.choice(["Yes.", "No", " ", "Why?", "a\nb!", f"t{rng.random()}."])) for t in turns]
    rng.shuffle(rows)
    return rows


def test_against_search(spark):
    rows = conversations(random.Random(2), 400, 9)
    assert found(dialogue.report(table(spark, rows, CLASHING).repartition(4))) == expected(rows)


def test_conversations_longer_than_a_chart(spark, monkeypatch):
    rows = conversations(random.Random(3), 60, 60)
    want = expected(rows)
    assert found(dialogue.report(table(spark, rows))) == want
    monkeypatch.setattr(dialogue, "LONG", 20)  # repeated rows by a join
    assert found(dialogue.report(table(spark, rows))) == want


def test_any_cut_into_blocks_gives_the_same():
    rng = random.Random(4)
    for _ in range(150):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b", "", f"{rng.random()}!"])) for _ in range(rng.randrange(0, 14))]
        results = []
        for size in (1, 2, 5, 20):
            talk, dialogue_block = dialogue.Repair(remember=True), dialogue.BLOCK
            dialogue.BLOCK = size
            for k, (role, text) in enumerate(rows):
                talk.add(k, role, text, not text, text.endswith((".", "!")), False)
            results.append(talk.result())
            dialogue.BLOCK = dialogue_block
        assert all(r == results[0] for r in results)
        want = expected([(1, k, *r) for k, r in enumerate(rows)] or [(1, 0, "user", "")], broken=False) if rows else None
        if want:
            assert tuple(results[0][f] for f in [*dialogue.FIGURES, "audit", "repaired_sha256"]) == want[1]


def test_a_long_conversation_takes_linear_time_and_room():
    rng = random.Random(6)
    talk = dialogue.Repair(remember=False)
    for k in range(30_000):
        talk.add(k, rng.choice(["user", "assistant", "system"]), f"{k}.", False, True, False)
        assert len(talk.block) <= dialogue.BLOCK and sum(len(p[1]) for p in talk.prefix.values()) < 2000
    out = talk.result()
    assert len(out["audit"].replace("I", "")) == 30_000
    assert out["cost"] == sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in out["audit"])


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, None, "assistant", "b."), (2, 1, "user", "x."), (2, 1, "user", "x."),
        (2, 1, "user", "x."), (3, 5, "system", "y" * 200_000 + "."), (4, 9, "é", "naïve 数字 😀."), (5, 0, "", ""), (6, -3, "user", "Go!"), (6, 4, "assistant", "Done.\v\f"),
    ]
    assert found(dialogue.report(table(spark, rows, CLASHING))) == expected(rows)
    assert dialogue.report(table(spark, rows).limit(0)).collect() == []


def test_conversations_that_lose_all_rows_stay(spark):
    rows = [(c, t, "user", "Hi.") for c in range(300) for t in [next(t for t in range(500) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)]]
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert found(dialogue.report(table(spark, rows))) == {c: nothing for c in range(300)}


def test_one_conversation_with_a_third_of_all_rows(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(dialogue, "LONG", 50)
    rows = [(0, t // 3, rng.choice(["user", "assistant"]), rng.choice(["same.", f"t{t}."])) for t in range(600)]
    rows += [(c + 1, t, "user" if t % 2 == 0 else "assistant", f"{c}.") for c in range(300) for t in range(4)]
    assert found(dialogue.report(table(spark, rows))) == expected(rows)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_given_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    assert found(dialogue.report(df)) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])

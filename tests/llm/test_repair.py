"""Conversation repair: against all edit sequences of small conversations, and large conversations in blocks against the same in one piece."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from tidemark.llm.queries import op13_conversation_repair
from tidemark.llm.repair import damaged, repair, repair_conversations

TEXTS = ["Fine.", "Yes!", "no end", "", " \n", "So?\t", "Fine."]
LEGAL = re.compile("(s?(ua)+)?")


def all_repairs(turns):
    """Every way: for each turn K, a new role or D, with up to two turns inserted at each place."""
    seen, faults = set(), []
    for role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    gaps = [[]] + [[x] for x in ("user", "assistant")] + [["user", "assistant"], ["assistant", "user"]]
    for inserted in product(gaps, repeat=len(turns) + 1):
        if sum(map(len, inserted)) > len(turns) + 2:
            continue
        for edits in product(("K", "user", "assistant", "D"), repeat=len(turns)):
            cost, audit, out = 0, "", []
            for k, more in enumerate(inserted):
                cost, audit, out = cost + 3 * len(more), audit + "I" * len(more), out + [(r, "") for r in more]
                if k == len(turns):
                    break
                kind, (role, text) = edits[k], turns[k]
                if kind == "D":
                    cost, audit = cost + 4, audit + "D"
                    continue
                if faults[k] in ("b", "d"):
                    cost = None
                    break
                cost += 3 * (faults[k] == "t") + 3 * (kind != "K")
                audit += "K" if kind == "K" else "R"
                out = [*out, (role if kind == "K" else kind, text)]
            if cost is not None and LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                yield cost, audit, out


def test_the_cheapest_of_all():
    rng = random.Random(3)
    for _ in range(60):
        turns = [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", " "]), rng.choice(TEXTS)) for _ in range(rng.randint(0, 3))]
        cost, audit, out = min(all_repairs(turns), key=lambda x: x[:2])
        got = repair([None] * len(turns), turns)
        assert (got[5], got[6], got[8]) == (cost, audit, out), turns
        assert got[7] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def some(seed=5):
    rng, rows = random.Random(seed), []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 60)):
            if rng.random() < 0.9:
                rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "", "tool", None]), rng.choice([*TEXTS, f"about {rng.randint(0, 30)}.", None])))
    return rows


def plain(rows):
    """By conversation, what `repair` makes of the sorted turns."""
    by, out = {}, {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        by.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{role}\n{text}".encode()).hexdigest(), role, text))
    for conv, turns in by.items():
        turns.sort()
        out[conv] = repair([t[1] if t[0] else None for t in turns], [t[3:] for t in turns])
    return out


SCHEMA = "conv_id long, turn long, role string, text string, said string, conv int"


@pytest.mark.parametrize(("whole_rows", "block_bytes"), [(10_000, 16 << 20), (20, 100), (0, 60)])
def test_blocks(spark, whole_rows, block_bytes):
    rows = some()
    found = repair_conversations(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3), whole_rows=whole_rows, block_bytes=block_bytes)
    want = plain(rows)
    assert {r["conv_id"]: tuple(r)[1:] for r in found.summary.collect()} == {k: v[:-1] for k, v in want.items()}
    turns = {}
    for r in sorted(found.turns.collect(), key=lambda r: (r["part"], r["place"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert turns == {k: v[-1] for k, v in want.items() if v[-1]}


def test_one_conversation_of_many_turns(spark):
    rows = [(7, k, ("user", "assistant")[k % 2 if k % 11 else 0], f"Number {k % 900} of them." + "ab " * (k % 40)) for k in range(30_000)]
    df = spark.createDataFrame(rows, SCHEMA.split(", said")[0])
    assert tuple(repair_conversations(df).summary.first())[1:] == plain(rows)[7][:-1]


def test_damage_and_query(spark, tmp_path):
    rows = some(8)
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    broken = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        broken += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    df = spark.read.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, damaged(df).collect()), key=str) == sorted(broken, key=str)
    want = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows} | {k: v[:-1] for k, v in plain(broken).items()}
    assert {r["conv_id"]: tuple(r)[1:] for r in op13_conversation_repair(spark, str(tmp_path)).collect()} == want


def test_empty(spark):
    found = repair_conversations(spark.createDataFrame([], SCHEMA))
    assert found.summary.count() == 0 and found.turns.count() == 0

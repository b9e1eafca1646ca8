"""Conversation structure repair: a forward Viterbi pass over each conversation, with the cheapest edits that make its roles (system? (user assistant)+)?.

Four states say what the roles so far end with: nothing, a system turn, a user turn, an assistant turn; the first and the last may end a conversation. Each state carries the
least (cost, audit string) that leads to it. A turn is kept, given another role or deleted; then the layer is closed with insertions, at most two, as a third would come back to a
state at a higher cost. Of equal costs the audit string that is first in ASCII wins. Equal costs mean that neither string begins with the other (each further letter costs or stands for a further turn),
so the choice between prefixes is the choice between whole strings.

Conversations of usual size are dealt by id, sorted, and repaired as they stream past. Larger ones (whole_rows, whole_bytes) are range-partitioned by turn into blocks; a block gives
its least (cost, audit) from every state to every state, which compose like the steps themselves, and is edited once the states at its ends are known. Both ways give
the same rows. Only the digest of a repaired conversation, which is serial by nature, streams through one task, row by row; and its audit string is one value of the result.

Defined results: a null role or text is one space; null turns come first; turns of one number in order of the SHA-256 of role and text; a null conv_id is a conversation of its own; a role
whose first letter isn't s, u or a (an empty one too) can't be kept; repeated rows are duplicates of the first; texts of any length are kept whole; an empty
table gives an empty result; extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import parts_for, written

WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn whose role begins with this letter.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
MADE = [(before, after) for (before, initial), after in AFTER.items() if initial != "s"]  # by a new turn or a new role
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)

Path = tuple[int, str] | None
Layer = list[Path]


def _least(a: Path, b: Path) -> Path:
    return b if a is None or b is not None and b < a else a


def close(layer: Layer) -> Layer:
    """With turns inserted: one, or two."""
    for _ in range(2):
        more = list(layer)
        for before, after in MADE:
            if layer[before]:
                more[after] = _least(more[after], (layer[before][0] + COST[INSERT], layer[before][1] + INSERT))
        layer = more
    return layer


def step(layer: Layer, initial: str, fault: int) -> Layer:
    """The layer after a turn."""
    after: Layer = [path and (path[0] + COST[DELETE], path[1] + DELETE) for path in layer]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST * (fault == TRUNCATED)
        for before, path in enumerate(layer):
            if path and (to := AFTER.get((before, initial))) is not None:
                after[to] = _least(after[to], (path[0] + more, path[1] + KEEP))
        for before, to in MADE:
            if path := layer[before]:
                after[to] = _least(after[to], (path[0] + COST[REROLE] + more, path[1] + REROLE))
    return close(after)


def walk(layer: Layer, turns: Iterable[tuple[str, int]]) -> tuple[str, Layer]:
    """(what the audit strings of all paths begin with, the layer without that) after turns of (initial, fault)."""
    done = []
    for k, (initial, fault) in enumerate(turns, 1):
        layer = step(layer, initial, fault)
        if k % 64 == 0:
            layer = _settle(done, layer)
    return "".join(done), layer


def _settle(done: list[str], layer: Layer) -> Layer:
    same = commonprefix([p[1] for p in layer if p])
    done.append(same)
    return [p and (p[0], p[1][len(same) :]) for p in layer]


def begun() -> Layer:
    return close([(0, ""), None, None, None])


def best(layer: Layer) -> int:
    """The state that a conversation ends in."""
    return min((s for s in (START, ASSISTANT) if layer[s]), key=lambda s: layer[s])


def edit(audit: str, turns: Iterable[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str]]:
    """The repaired (role, text), from the state that the turns before have led to."""
    rows = iter(turns)
    for letter in audit:
        role, text = next(rows) if letter != INSERT else (None, "")
        if letter == DELETE:
            continue
        if letter != KEEP:
            role = "assistant" if state == USER else "user"
        state = AFTER[state, role[0]]
        yield role, text


def _faults(turns: list[tuple[str, str]]) -> list[int]:
    seen, out = set(), []
    for turn in turns:
        bare = turn[1].strip(WHITE)
        out.append(BLANK if not bare else DUPLICATE if turn in seen else TRUNCATED if bare[-1] not in ".!?" else NO_FAULT)
        seen.add(turn)
    return out


def _illegal(initials: list[str]) -> int:
    """Neighbours that may not follow each other."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "array<struct<role: string, text: string>>"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def repair(numbers: list[int | None], turns: list[tuple[str, str]]) -> tuple:
    """A conversation's summary, from gaps on, and its repaired turns."""
    faults, initials = _faults(turns), [role[:1] for role, _ in turns]
    same, layer = walk(begun(), zip(initials, faults))
    cost, audit = layer[best(layer)]
    audit, known = same + audit, {n for n in numbers if n is not None}
    repaired = list(edit(audit, turns))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), _illegal(initials), cost, audit, sha, repaired


def _stream(batches: Iterator[pa.RecordBatch], with_turns: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation; one is held at a time."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in SUMMARY.split(", ")]
    numbers, turns, conv, out = [], [], None, []

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out))
        held = [pa.array([[{"role": r, "text": t} for r, t in x] for x in columns[-1]], _TURNS)] if with_turns else []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)] + held, names + ["repaired"] * with_turns)

    for batch in batches:
        for c, n, r, t in zip(*(batch[k].to_pylist() for k in ("conv_id", "turn", "role", "text"))):
            if turns and c != conv:
                out.append((conv, *repair(numbers, turns)))
                numbers, turns = [], []
            conv = c
            numbers.append(n)
            turns.append((r, t))
        if out:
            yield flushed()
            out = []
    if turns:
        out = [(conv, *repair(numbers, turns))]
        yield flushed()


def _read(convs: DataFrame) -> DataFrame:
    """conv: the id as text, never null."""
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "*", F.sha2(F.concat("role", F.lit("\n"), "text"), 256).alias("said"))


def _usual(rows: DataFrame, with_turns: bool) -> DataFrame:
    dealt = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "said")
    return dealt.select("conv_id", "turn", "role", "text").mapInArrow(lambda batches: _stream(batches, with_turns), SUMMARY + f", repaired {TURNS}" * with_turns)


def _matrix(key: tuple[pa.Scalar, ...], turns: pa.Table) -> pa.Table:
    """A row for each start of a block: for each end the least cost (-1: none) and audit; and the block's counts."""
    turns = turns.sort_by("at")
    initials, faults = turns["initial"].to_pylist(), turns["fault"].to_pylist()
    own = {"conv": key[0].as_py(), "part": key[1].as_py(), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED)}
    own |= {"illegal": _illegal(initials), "first": initials[0], "last": initials[-1]}
    rows = []
    for start in range(4):
        same, layer = walk([(0, "") if s == start else None for s in range(4)], zip(initials, faults))
        rows.append(own | {"start": start, "costs": [p[0] if p else -1 for p in layer], "audits": [same + p[1] if p else "" for p in layer]})
    return pa.Table.from_pylist(rows, _MATRIX)


MATRIX = "conv string, part int, blank long, duplicate long, truncated long, illegal long, first string, last string, start int, costs array<long>, audits array<string>"
_MATRIX = pa.schema([("conv", pa.string()), ("part", pa.int32()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()), ("start", pa.int32()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _chain(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
    """A row for each block of a conversation: the state before it, its part of the audit string, and in each row the conversation's sums."""
    rows = blocks.sort_by([("part", "ascending"), ("start", "ascending")]).to_pylist()
    parts = [rows[k : k + 4] for k in range(0, len(rows), 4)]
    done, layer, came = [], begun(), []
    opening = [p[1] if p else "" for p in layer]
    for four in parts:
        after: Layer = [None] * 4
        chosen = [0] * 4
        for row, path in zip(four, layer):
            for end, (cost, audit) in enumerate(zip(row["costs"], row["audits"])):
                if path and cost >= 0 and (after[end] is None or (path[0] + cost, path[1] + audit) < after[end]):
                    after[end], chosen[end] = (path[0] + cost, path[1] + audit), row["start"]
        came.append(chosen)
        layer = _settle(done, after)
    state = best(layer)
    cost, audit = layer[state][0], "".join(done) + layer[state][1]
    slices = []
    for four, chosen in zip(reversed(parts), reversed(came)):
        before = chosen[state]
        slices.append((before, four[before]["audits"][state]))
        state = before
    slices.reverse()
    # turns may be inserted before the first
    slices[0] = (START, opening[slices[0][0]] + slices[0][1])
    sums = {c: sum(four[0][c] for four in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
    sums["illegal"] += sum(_illegal([a[0]["last"], b[0]["first"]]) for a, b in zip(parts, parts[1:]))
    same = {"conv": key[0].as_py(), "cost": cost} | sums
    return pa.Table.from_pylist([same | {"part": four[0]["part"], "before": before, "slice": part, "audit": audit if k == 0 else None} for k, (four, (before, part)) in enumerate(zip(parts, slices))], _CHAIN)


CHAIN = "conv string, cost long, blank long, duplicate long, truncated long, illegal long, part int, before int, slice string, audit string"
_CHAIN = pa.schema([("conv", pa.string()), *((c, pa.int64()) for c in ("cost", "blank", "duplicate", "truncated", "illegal")), ("part", pa.int32()), ("before", pa.int32()), ("slice", pa.string()), ("audit", pa.string())])


def _edited(key: tuple[pa.Scalar, ...], turns: pa.Table, chosen: pa.Table) -> pa.Table:
    turns, row = turns.sort_by("at"), chosen.to_pylist()[0]
    rows = list(edit(row["slice"], zip(turns["role"].to_pylist(), turns["text"].to_pylist()), row["before"]))
    n = len(rows)
    roles, texts = zip(*rows) if rows else ((), ())
    return pa.table({"conv": pa.repeat(key[0], n), "part": pa.repeat(key[1].cast(pa.int32()), n), "place": pa.array(range(n), pa.int32()), "role": pa.array(roles, pa.string()), "text": pa.array(texts, pa.string())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv = digest = None
    for batch in batches:
        out = []
        for c, r, t in zip(*(batch[k].to_pylist() for k in ("conv", "role", "text"))):
            if c != conv or digest is None:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256(f"{r}:{t}".encode())
            else:
                digest.update(f"\n{r}:{t}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["conv", "sha"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], ["conv", "sha"])


def _blocks(rows: DataFrame, n_bytes: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Summary and repaired turns (conv_id, part, place, role, text) of large conversations, by way of blocks of turns."""
    order = ["conv", F.col("turn").asc_nulls_first(), "said", "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts_for(rows.sparkSession, n_bytes, block_bytes), *order).sortWithinPartitions(*order)
    # after the sort this id goes up with the place in the whole order
    turns = written(dealt.select("conv", "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "turn", "role", "text", "said"), "turns")
    firsts = turns.groupBy("conv", "said").agg(F.min("at").alias("first_at"))
    bare = F.trim(F.translate("text", WHITE, " " * len(WHITE)))
    fault = F.when(bare == "", BLANK).when(F.col("at") > F.col("first_at"), DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT)
    judged = turns.select("conv", "part", "at", "said", "text", F.substring("role", 1, 1).alias("initial")).join(firsts, ["conv", "said"]).select("conv", "part", "at", "initial", fault.alias("fault"))
    chains = written(judged.groupBy("conv", "part").applyInArrow(_matrix, MATRIX).groupBy("conv").applyInArrow(_chain, CHAIN), "chains")
    edited = written(turns.select("conv", "part", "at", "role", "text").groupBy("conv", "part").cogroup(chains.select(F.col("conv").alias("of"), F.col("part").alias("block"), "before", "slice").groupBy("of", "block")).applyInArrow(_edited, "conv string, part int, place int, role string, text string"), "edited")
    shas = edited.repartition("conv").sortWithinPartitions("conv", "part", "place").select("conv", "role", "text").mapInArrow(_digests, "conv string, sha string")
    known = turns.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("span"))
    numbers = turns.where("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    summary = (
        chains.where("audit is not null").join(known, "conv").join(numbers, "conv", "left").join(shas, "conv", "left")
        .withColumns({"gaps": F.col("span") - F.coalesce("n", F.lit(0)), "repaired_sha256": F.coalesce("sha", F.sha2(F.lit(""), 256))})
    )
    return summary.select(*(c.split()[0] for c in SUMMARY.split(", "))), edited.join(known.select("conv", "conv_id"), "conv")


class Repaired(NamedTuple):
    summary: DataFrame  # SUMMARY: a row for each conversation
    turns: DataFrame  # conv_id, part, place, role, text: in order of part and place


def repair_conversations(convs: DataFrame, whole_rows: int = 10_000, whole_bytes: int = 16 << 20, block_bytes: int = 16 << 20) -> Repaired:
    """Repairs conversations of (conv_id, turn, role, text). Those of over whole_rows turns or whole_bytes are split into blocks."""
    rows = _read(convs)
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    large = written(sizes.where((F.col("n") > whole_rows) | (F.col("bytes") > whole_bytes)), "large")
    held = large.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    usual = rows.join(large, "conv", "left_anti") if held["n"] else rows
    whole = _usual(usual, True).select("conv_id", F.lit(0).alias("part"), F.posexplode("repaired").alias("place", "turn")).select("conv_id", "part", "place", "turn.*")
    summary = _usual(usual, False)
    if not held["n"]:
        return Repaired(summary, whole)
    more, turns = _blocks(rows.join(large, "conv", "left_semi"), held["bytes"], block_bytes)
    return Repaired(summary.unionByName(more), whole.unionByName(turns.select(*whole.columns)))


def damaged(convs: DataFrame, every: int = 20) -> DataFrame:
    """Rows with planted faults, by the CRC of `conv_id:turn`: of so many remainders 0 drops a row, 1 empties its text, 2 takes the text's ends of sentences,
    3 repeats the row, 4 makes the role user. A null is one space."""
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1]).cast("binary")) % every
    rows = convs.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_time")).drop("_time")

"""Exact dedup by a content sort: equal texts become neighbours, and neighbours are compared in full.

Texts are normalised (white space deleted). ``repartitionByRange`` samples splitters and deals the rows by (first bytes of the normalised text, its SHA-256,
longest original first, smallest id, row number); Spark's external sort then orders each partition by the same key, spilling as it needs to.
The key goes on to the row number, so a group of copies, however large, is cut by splitters like any other range, and splitters are short whatever the length of the texts.
One pass over each sorted partition compares every text with its neighbour, byte by byte. Runs inside a partition are settled there; of the first and the last run
the text is kept once, and compared with the neighbouring partition's, so that runs are chained across any number of partitions. What is chained is two rows for a
partition, whatever the size of the corpus.

Defined results: a null text counts as empty; null ids come last among equals; of repeated rows (same id and text) the one first in the table's order stays; texts of any length
are compared whole; an empty table gives an empty result; extra columns are not returned by ``exact_groups`` and kept by ``drop_copies``. Two different texts of one SHA-256 would
stay two groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import parts_for, text_bytes, written

WHITE = " \t\n\x0b\x0c\r"
HEAD_BYTES = 32
#: A partition's share of the text: it grows with the root of the corpus, so that the blocks of the shuffle don't grow with its square.
LEAST_PART, MOST_PART, ROOT_BYTES = 64 << 20, 2 << 30, 64 << 10
FIRST, LAST = 1, 2


def part_bytes(n_bytes: int) -> int:
    return min(MOST_PART, max(LEAST_PART, math.isqrt(n_bytes * ROOT_BYTES)))


def _normalised(text) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "").cast("binary")


NAMES = ["doc_id", "sha", "keep_id", "size", "starts", "part", "border", "text"]


def _batch(ids: pa.Array, shas: pa.Array, at: np.ndarray, part: int, border: int, text: bytes | None, carried: pa.Array | None) -> pa.RecordBatch:
    """Rows of whole runs that begin at these places; text is that of the first."""
    n = len(ids)
    sizes = np.diff(np.append(at, n))
    first = np.repeat(at, sizes)
    starts = first == np.arange(n)
    same = lambda value, kind: pa.repeat(pa.scalar(value, kind), n)
    texts = pa.nulls(n, pa.large_binary()) if text is None else pa.concat_arrays([pa.array([text], pa.large_binary()), pa.nulls(n - 1, pa.large_binary())])
    columns = [ids, shas, ids.take(pa.array(first)), pa.array(np.repeat(sizes, sizes).astype(np.int64)), pa.array(starts), same(part, pa.int32()), same(border, pa.int32()), texts]
    if carried is not None:
        columns.append(carried.take(pa.array(np.where(starts, np.cumsum(starts) - 1, 0), mask=~starts)))
    return pa.RecordBatch.from_arrays(columns, NAMES + ["carried"] * (carried is not None))


def _mark_runs(batches: Iterator[pa.RecordBatch], part: int, carry: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their run: size, whose id stays, whether the row is the run's first, and which border of the partition the run touches.

    The last run of a batch may go on: its ids and its one text are held until the next run begins.
    """
    ids: list[pa.Array] = []
    text = sha = head = None
    first = True

    def closed(last: bool) -> pa.RecordBatch:
        nonlocal first
        border, every = FIRST * first | LAST * last, pa.concat_arrays(ids)
        first = False
        return _batch(every, pa.repeat(sha, len(every)), np.zeros(1, np.int64), part, border, text if border else None, head)

    for batch in batches:
        n = len(batch)
        if not n:
            continue
        texts = batch["norm"]
        cuts = np.flatnonzero(pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)) + 1
        if not ids or texts[0].as_py() != text:
            cuts = np.insert(cuts, 0, 0)
        go_on = int(cuts[0]) if len(cuts) else n
        if go_on:
            ids.append(batch["doc_id"][:go_on])
        while len(cuts):  # at most three turns: the run that was open or the partition's first, those within, and the one that stays open
            if ids:
                yield closed(False)
                ids = []
            if not first and len(cuts) > 1:
                a, b = int(cuts[0]), int(cuts[-1])
                yield _batch(batch["doc_id"][a:b], batch["sha"][a:b], cuts[:-1] - a, part, 0, None, batch["carried"].take(pa.array(cuts[:-1])) if carry else None)
                cuts = cuts[-1:]
            a, b = int(cuts[0]), int(cuts[1]) if len(cuts) > 1 else n
            ids, text, sha, head = [batch["doc_id"][a:b]], texts[a].as_py(), batch["sha"][a], batch["carried"][a : a + 1] if carry else None
            cuts = cuts[1:]
    if ids:
        yield closed(True)


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    norm = _normalised(F.col(text_col))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(None).cast("int")
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"), F.sha2(norm, 256).alias("sha"), F.substring(norm, 1, HEAD_BYTES).alias("head"),
        (-F.char_length(F.coalesce(F.col(text_col), F.lit("")))).alias("shorter"), F.monotonically_increasing_id().alias("row"), row.alias("carried"))
    order = [F.col("head"), F.col("sha"), F.col("shorter"), F.col("doc_id").asc_nulls_last(), F.col("row")]
    n_bytes = text_bytes(docs, text_col)
    dealt = keyed.repartitionByRange(parts_for(docs.sparkSession, n_bytes, part_bytes(n_bytes)), *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        return _mark_runs(batches, TaskContext.get().partitionId(), carry)

    schema = T._parse_datatype_string("doc_id long, sha string, keep_id long, size long, starts boolean, part int, border int, text binary")
    if carry:
        schema = schema.add("carried", keyed.schema["carried"].dataType)
    return dealt.select("doc_id", "norm", "sha", *(["carried"] if carry else [])).mapInArrow(run, schema)


def _chained(runs: DataFrame) -> DataFrame:
    """(part, border, whole_size, whole_id, begins): what the runs at the partitions' borders are part of. Windows over all partitions here have a row or two for each, without texts."""
    ends = runs.where("border > 0 and starts").select("part", "border", "size", "keep_id", "text")
    by_part = W.orderBy("part")
    firsts = ends.where(F.col("border").bitwiseAND(FIRST) > 0)
    lasts = ends.where(F.col("border").bitwiseAND(LAST) > 0)
    before = firsts.select("part").withColumn("before", F.lag("part").over(by_part))
    same = (
        before.where("before is not null")
        .join(firsts.select("part", F.col("text").alias("mine")), "part")
        .join(lasts.select(F.col("part").alias("before"), F.col("text").alias("theirs")), "before")
        .where("mine = theirs")
        .select("part")
    )
    parts = (
        firsts.select("part", F.col("size").alias("first_size"), (F.col("border") == FIRST | LAST).alias("single"))
        .join(lasts.select("part", F.col("size").alias("last_size"), F.col("keep_id").alias("last_id")), "part")
        .join(same.withColumn("goes_on", F.lit(True)), "part", "left")
        .withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    )
    # chain: the partition whose last run it begins with; a partition of one run that goes on doesn't begin any
    opens = F.when(~(F.col("goes_on") & F.col("single")), F.col("part"))
    chains = parts.withColumn("opened", F.last(opens, True).over(by_part)).withColumn("came_from", F.lag("opened").over(by_part))
    pieces = chains.select(F.col("part").alias("chain"), F.col("last_size").alias("n")).where(F.col("opened") == F.col("part")).unionByName(chains.where("goes_on").select(F.col("came_from").alias("chain"), F.col("first_size").alias("n")))
    sums = pieces.groupBy("chain").agg(F.sum("n").alias("whole_size")).join(chains.select(F.col("part").alias("chain"), F.col("last_id").alias("whole_id")), "chain")
    going = chains.where("goes_on").select("part", F.when(F.col("single"), FIRST | LAST).otherwise(FIRST).alias("border"), F.col("came_from").alias("chain"), F.lit(False).alias("begins"))
    opening = chains.where((F.col("opened") == F.col("part"))).select("part", F.when(F.col("single"), FIRST | LAST).otherwise(LAST).alias("border"), F.col("part").alias("chain"), F.lit(True).alias("begins"))
    return going.unionByName(opening).join(sums, "chain").drop("chain")


def _settled(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    runs = written(_sorted_runs(docs, id_col, text_col, carry), "sorted-runs")
    whole = F.coalesce
    return (
        runs.drop("text")
        .join(_chained(runs), ["part", "border"], "left")
        .withColumns({"keep_id": F.when(F.col("whole_size").isNull(), F.col("keep_id")).otherwise(F.col("whole_id")), "group_size": whole("whole_size", "size"), "kept": F.col("starts") & whole("begins", F.lit(True))})
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: (doc_id, keep_id, group_size, kept, text_sha256)."""
    return _settled(docs, id_col, text_col, False).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    return _settled(docs, id_col, text_col, True).where("kept").select("carried.*")

"""Shards of near equal size: a minimax contiguous partition of atomic groups.

Equal texts form a group that stays together. Groups are ordered by the first ``order_bits`` bits of the MD5 of the text;
groups that agree in these bits are one atomic cell, so that there are at most 2 ** order_bits cells (2 ** 20 by
default, 16 MB on the driver) whatever the size of the corpus. The smallest shard capacity that holds all cells in order
is found by binary search, with a greedy check on prefix sums, and the cuts are made under that capacity.

Defined results: a null text counts as empty; null ids are kept; repeated rows are rows like any other; texts of any length count whole, and one larger than a shard's share
makes that shard larger; rows of equal id and text may take each other's slot; cuts that are equally near to a share go behind; an empty table
gives an empty result; extra columns of the input are not returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import gapless_rank, written

ROW_OVERHEAD = 8


def greedy_cuts(total_before: np.ndarray, capacity: int, shards: int, start: int = 0) -> list[int] | None:
    """Ends of the shards if every shard from cell start on takes all that fits; None if cells are left over.

    total_before has the sum of the sizes before each cell, and the grand total as its last entry.
    """
    ends, at, n = [], start, len(total_before) - 1
    for _ in range(shards):
        at = int(np.searchsorted(total_before, total_before[at] + capacity, side="right")) - 1
        ends.append(at)
        if at == n:
            return ends
    return None


def minimax_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity for which the ordered sizes fit into so many contiguous shards."""
    if not len(sizes):
        return 0
    before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    low, high = max(int(sizes.max()), -(-int(before[-1]) // shards)), int(before[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(before, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def minimax_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """The first cell of each shard but the first. No shard exceeds the minimax capacity; under it, each cut is put as
    near as possible to an equal share of what is left, so that one giant cell doesn't leave other shards empty."""
    n = len(sizes)
    before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    capacity, cuts, at = minimax_capacity(sizes, shards), [], 0
    for left in range(shards, 1, -1):
        share = (before[n] - before[at]) / left
        most = int(np.searchsorted(before, before[at] + capacity, side="right")) - 1
        near = int(np.searchsorted(before, before[at] + share, side="left"))
        if near > at and before[min(near, n)] - before[at] - share > before[at] + share - before[near - 1]:
            near -= 1
        end = max(at, min(near, most, n))
        while end < most and greedy_cuts(before, capacity, left - 1, end) is None:
            end += 1
        cuts.append(end)
        at = end
    return cuts


def shard_documents(docs: DataFrame, shards: int = 24, order_bits: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, cell, shard, slot): size is the UTF-8 length plus 8, slot numbers a shard's rows from 0."""
    if not 1 <= order_bits <= 24:
        raise ValueError("order_bits must be from 1 to 24: the driver holds a number for each cell")
    text = F.coalesce(F.col(text_col), F.lit(""))
    first_bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("int")
    rows = written(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftright(first_bits, 24 - order_bits).alias("cell")), "shard-rows")
    sums = rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).toArrow().sort_by("cell")
    cells, n_rows = sums["cell"].to_numpy(), int(sums["n"].to_numpy().sum())
    firsts = [int(cells[c]) if c < len(cells) else 1 << order_bits for c in minimax_cuts(sums["size"].to_numpy(), shards)] if len(cells) else []
    shard = sum((F.when(F.col("cell") >= c, 1).otherwise(0) for c in firsts), F.lit(0)).cast("int")
    return gapless_rank(rows.withColumn("shard", shard), ["shard"], ["doc_id", "text_crc32"], "doc_id", n_rows // shards + 1, "slot")

"""Trailing windows and linear recurrences over long ordered series, without one task for each series.

Rows are numbered by counts of coarse spans of time plus a number within the span. Series are then cut into blocks of rows; a block also gets the
last rows of the one before, as many as a trailing window needs.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = 30 * 86_400_000_000_000
BLOCK = 4096


def numbered(rows: DataFrame, keys: list[str], order: str = "ts_utc_ns", span: int = SPAN) -> DataFrame:
    """Adds rn, the row's number from 0 within keys by a unique order column."""
    cut = rows.withColumn("_span", F.expr(f"({order} - pmod({order}, {span}))"))
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "_span").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy(*keys, "_span").orderBy(order)) - 1
    return cut.withColumn("_within", within).join(starts, [*keys, "_span"]).withColumn("rn", F.col("_before") + F.col("_within")).drop("_span", "_before", "_within")


def trailing(rows: DataFrame, keys: list[str], reach: int, make: Callable[[object], dict[str, Column]], block: int = BLOCK) -> DataFrame:
    """Adds columns over windows that look back at most reach rows. rows: numbered; make(window) gives the columns, from a window
    ordered by rn to which a frame can be put."""
    size = max(block, 4 * reach)
    copies = F.when(F.col("rn") % size >= size - reach, F.array(F.floor(F.col("rn") / size), F.floor(F.col("rn") / size) + 1)).otherwise(F.array(F.floor(F.col("rn") / size)))
    wide = rows.withColumn("_block", F.explode(copies))
    w = W.partitionBy(*keys, "_block").orderBy("rn")
    return wide.withColumns(make(w)).where(F.col("_block") == F.floor(F.col("rn") / size)).drop("_block")


def carry(ends: DataFrame, keys: list[str], order: str, decay: float) -> DataFrame:
    """(keys, order, _carry): y before each block of a recurrence, from a row for each block with _end, its own last value, and _len, its rows."""
    types = {f.name: f.dataType.simpleString() for f in ends.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, value, out = pdf.sort_values(order), 0.0, []
        for end, n in zip(pdf["_end"], pdf["_len"]):
            out.append(value)
            value = end + decay**n * value
        return pdf.assign(_carry=out)[[*keys, order, "_carry"]]

    return ends.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in [*keys, order]) + ", _carry double")


def recurrence(rows: DataFrame, keys: list[str], decay: float, x: str, out: str, number: str = "rn", block: int = BLOCK) -> DataFrame:
    """y[i] = decay * y[i-1] + x[i], with y before the first row 0. rows: with a number from 0 for each key.

    Within a block a running sum of x / decay**k, times decay**k; one row for each block carries the value on, in order; then both are
    added. block is kept short enough for decay**-block to stay far from overflow.
    """
    import math

    size = max(1, min(block, int(280 / -math.log(decay)) if decay < 1 else block))
    placed = rows.withColumn("_block", F.floor(F.col(number) / size).cast("long")).withColumn("_k", F.col(number) % size)
    w = W.partitionBy(*keys, "_block").orderBy("_k")
    local = placed.withColumn("_local", F.pow(F.lit(decay), F.col("_k")) * F.sum(F.col(x) * F.pow(F.lit(decay), -F.col("_k"))).over(w))
    ends = local.groupBy(*keys, "_block").agg(F.max_by("_local", "_k").alias("_end"), F.count(F.lit(1)).alias("_len"))
    carried = carry(ends, keys, "_block", decay)
    return local.join(carried, [*keys, "_block"]).withColumn(out, F.col("_local") + F.col("_carry") * F.pow(F.lit(decay), F.col("_k") + 1)).drop("_block", "_k", "_local", "_carry")

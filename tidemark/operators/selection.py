"""Values at given ranks of large groups, and exact quantiles, without a group's values in one place.

A double becomes a 64-bit whole number of the same order. Four passes count the rows of each group by 16 of its bits at a time, from the highest on: each pass tells which of 65,536
bins has a wanted rank, and the next counts the rows of that bin only. Counts are summed in the tasks that read the rows, so a pass shuffles no more than bins, and a pass's
answer, a small written table, is a row for each wanted rank. Four passes at most, for any size and any distribution, and two for small groups; nothing is sampled or
approximated.

The rows are read once in each pass: what is expensive to make should be a written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from tidemark.sources.scratch import written

BITS = 16
#: Rows of the bins that wanted ranks are in, of all groups: with so few left, the next pass counts single values and is the last.
DIRECT = 1_000_000
#: Values that an aggregation's buffer may hold for a group: up to here Spark's own percentile is used.
BUFFERED = 5_000_000


def _turned(bits: np.ndarray) -> np.ndarray:
    """Bits of a double to a whole number of the same order, and back."""
    return np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits)


@F.arrow_udf(LongType())
def ordered_bits(value: pa.Array) -> pa.Array:
    """Whole numbers in the order of the doubles; NaN comes last, 0 and -0 are one."""
    v = value.to_numpy(zero_copy_only=False) + 0.0
    return pa.array(_turned(np.where(np.isnan(v), np.nan, v).view(np.int64)))


@F.arrow_udf(DoubleType())
def from_ordered_bits(key: pa.Array) -> pa.Array:
    return pa.array(_turned(key.to_numpy(zero_copy_only=False)).view(float))


def _same(keys: list[str], other: str = "_of_") -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys]


def at_ranks(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame, direct: int = DIRECT) -> DataFrame:
    """(keys, rank, value, below, equal) for each of wanted (keys, rank from 0; distinct): the group's value of that rank in ascending order. below and equal: how many are less, and how many the same.
    Rows without a value don't count; ranks beyond a group's values are left out."""
    bits = rows.where(F.col(value).isNotNull()).select(*keys, ordered_bits(F.col(value).cast("double")).alias("_k"))
    # found: how many values lie below the bin that the rank is in, and the bin's bits so far
    found = wanted.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "rank", F.lit(0).cast("long").alias("_below"), F.lit(None).cast("long").alias("_bits"))
    owned, few = [f"_of_{k}" for k in keys], False
    above = shift = 64
    while shift:
        above, shift = shift, 0 if few else shift - BITS
        part = F.shiftright("_k", shift)
        if above == 64:
            counts = bits.groupBy(*keys, part.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
            within, on = W.partitionBy(*keys).orderBy("_bin"), _same(keys)
        else:
            inside = bits.withColumn("_high", F.shiftright("_k", above)).join(found.select(*owned, "_bits").distinct(), [*_same(keys), F.col("_high") == F.col("_bits")])
            counts = inside.groupBy(*keys, "_high", part.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
            within, on = W.partitionBy(*keys, "_high").orderBy("_bin"), [*_same(keys), F.col("_high") == F.col("_bits")]
        ends = counts.withColumn("_end", F.sum("_c").over(within))
        offset = F.col("rank") - F.col("_below")
        met = ends.join(found, on).where((offset >= F.col("_end") - F.col("_c")) & (offset < F.col("_end")))
        # a row for each rank; read twice by the next pass
        found = written(met.select(*owned, "rank", (F.col("_below") + F.col("_end") - F.col("_c")).alias("_below"), F.col("_bin").alias("_bits"), F.col("_c").alias("_equal")), "ranks")
        few = shift and (found.select(*owned, "_bits", "_equal").distinct().agg(F.sum("_equal").alias("n")).first()["n"] or 0) <= direct
    return found.select(*(F.col(f"_of_{k}").alias(k) for k in keys), "rank", from_ordered_bits("_bits").alias("value"), F.col("_below").alias("below"), F.col("_equal").alias("equal"))


def selected_quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """(keys, n, q): the values at probs, interpolated between two ranks as Spark's percentile does, bit for bit."""
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("n")).where("n > 0")
    at = F.posexplode(F.array(*(F.lit(float(p)) for p in probs)))
    places = sizes.select(*keys, "n", at.alias("_i", "_p")).withColumn("_at", (F.col("n") - 1) * F.col("_p")).withColumns({"_lo": F.floor("_at"), "_hi": F.ceil("_at")})
    wanted = places.select(*keys, F.explode(F.array("_lo", "_hi")).alias("rank")).distinct()
    values = at_ranks(rows, keys, value, wanted)
    side = lambda name: values.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("rank").alias("_rank"), F.col("value").alias(name))
    low = places.join(side("_a"), [*_same(keys), F.col("_rank") == F.col("_lo")]).drop("_rank", *(f"_of_{k}" for k in keys))
    both = low.join(side("_b"), [*_same(keys), F.col("_rank") == F.col("_hi")])
    q = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.col("_hi") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.col("_lo")) * F.col("_b"))
    return both.withColumn("_q", q).groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias("q"))


def quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float], buffered: int = BUFFERED) -> DataFrame:
    """(keys, n, q): exact quantiles of groups of any size. While all rows together fit an aggregation's buffer they are Spark's percentile, else they are selected: the same values."""
    if rows.count() > buffered:
        return selected_quantiles(rows, keys, value, probs)
    q = F.percentile(value, F.array(*(F.lit(float(p)) for p in probs)))
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), q.alias("q")).where("n > 0")

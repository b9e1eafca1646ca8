"""Bootstrap intervals of medians with the work of one group split over many tasks.

A resample of n values draws n ranks with replacement, and its median is the mean of the values at the two middle ones of them: which ranks these are takes no values. Draws are a function
of (seed, resample, number of the draw), so a task draws whichever resamples it is given, in blocks, without a stream to carry on, and a result is the same however
the work is dealt out. The ranks that the middles fall on are then looked up by ``selection.at_ranks``: a group is neither sorted nor gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.selection import _same, at_ranks
from tidemark.sources.scratch import written

#: Draws that a task makes: of one resample or of several. Draws held at a time.
TASK_DRAWS, BLOCK = 20_000_000, 4_000_000
LEAST = 10
# The multipliers of the finalizer of MurmurHash3, 32 bits.
_MIX = (0x85EBCA6B, 0xC2B2AE35)


def mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit number (as uint64) with its bits stirred."""
    for shift, factor in zip((16, 13), _MIX):
        x = x ^ (x >> np.uint64(shift))
        x = x * np.uint64(factor) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


def _stream(seed: int, resamples: np.ndarray) -> np.ndarray:
    """What tells the draws of one resample from those of another."""
    return mix((mix(np.array([seed & 0xFFFFFFFF], np.uint64)) + resamples.astype(np.uint64)) & np.uint64(0xFFFFFFFF))


def drawn(seed: int, resamples: np.ndarray, first: int, last: int, n: int) -> np.ndarray:
    """The ranks of draws first to last - 1, from 0 to n - 1 (n below 2**32): a row for each resample."""
    own = _stream(seed, resamples)[:, None]
    at = np.arange(first, last, dtype=np.uint64)[None, :]
    return (mix(mix(at ^ own) ^ (own >> np.uint64(1))) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def middle_ranks(seed: int, first: int, last: int, n: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The two middle ones of the ranks of resamples first to last - 1, equal or not. Of large groups the draws are counted in coarse bins, and made again to look into those of the
    middle, so that no more than a block is held."""
    places = [(n - 1) // 2, n // 2]
    if n <= block:
        step = max(1, block // n)
        both = [np.partition(drawn(seed, np.arange(k, min(last, k + step)), 0, n, n), places, axis=1)[:, places] for k in range(first, last, step)]
        return tuple(np.concatenate(both).T)
    found = [_middle_of_many(seed, k, n, places, block) for k in range(first, last)]
    return np.array([x for x, _ in found]), np.array([x for _, x in found])


def _middle_of_many(seed: int, resample: int, n: int, places: list[int], block: int) -> tuple[int, int]:
    own, width = np.array([resample]), -(-n // 65_536)
    blocks = [(at, min(n, at + block)) for at in range(0, n, block)]
    counts = sum(np.bincount(drawn(seed, own, *b, n)[0] // width, minlength=65_536) for b in blocks)
    ends = np.cumsum(counts)
    low, high = np.searchsorted(ends, places, "right")
    kept = []
    for b in blocks:
        x = drawn(seed, own, *b, n)[0]
        kept.append(x[(x // width == low) | (x // width == high)])
    inside = np.sort(np.concatenate(kept))
    # between the two bins of the middle there are no draws
    before = ends[low] - counts[low]
    return int(inside[places[0] - before]), int(inside[places[1] - before])


def split_bootstrap(rows: DataFrame, keys: list[str], value: str, seed: Column, resamples: int = 2000, least: int = LEAST, level: float = 0.95, task_draws: int = TASK_DRAWS) -> DataFrame:
    """(keys, n, median, ci_low, ci_high); groups of fewer than least values get no interval. seed: an expression of the keys."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fed = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sizes = fed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    many = F.greatest(F.lit(1).cast("long"), F.lit(task_draws).cast("long") / F.col("n")).cast("long")
    tasks = (
        sizes.where(F.col("n") >= least).withColumns({"_seed": seed.cast("long"), "_many": many})
        .withColumn("_first", F.explode(F.expr(f"sequence(0L, {resamples - 1}L, _many)"))).withColumn("_last", F.least(F.col("_first") + F.col("_many"), F.lit(resamples).cast("long")))
    )
    # each row here is up to task_draws draws: they are dealt out one by one
    dealt = tasks.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism), *keys, "_first")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.to_dict("records"):
                first, last = int(row["_first"]), int(row["_last"])
                lo, hi = middle_ranks(int(row["_seed"]), first, last, int(row["n"]))
                yield pd.DataFrame({**{k: [row[k]] * (last - first) for k in keys}, "resample": np.arange(first, last), "lo": lo, "hi": hi})

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", resample long, lo long, hi long"
    middles = dealt.select(*keys, "n", "_seed", "_first", "_last").mapInPandas(draw, schema)
    own = sizes.select(*keys, F.lit(-1).cast("long").alias("resample"), F.floor((F.col("n") - 1) / 2).alias("lo"), F.floor(F.col("n") / 2).alias("hi"))
    ranks = written(middles.unionByName(own), "ranks")  # read twice, drawn once
    values = at_ranks(fed, keys, value, ranks.select(*keys, F.explode(F.array("lo", "hi")).alias("rank")).distinct())
    side = lambda name: values.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("rank").alias("_rank"), F.col("value").alias(name))
    low = ranks.join(side("_a"), [*_same(keys), F.col("_rank") == F.col("lo")]).drop("_rank", *(f"_of_{k}" for k in keys))
    medians = low.join(side("_b"), [*_same(keys), F.col("_rank") == F.col("hi")]).select(*keys, "resample", ((F.col("_a") + F.col("_b")) / 2).alias("m"))
    tails = F.percentile(F.when(F.col("resample") >= 0, F.col("m")), F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    found = medians.groupBy(*keys).agg(F.max(F.when(F.col("resample") < 0, F.col("m"))).alias("median"), tails.alias("_q")).select(*(F.col(k).alias(f"_of_{k}") for k in keys), "median", F.get("_q", F.lit(0)).alias("ci_low"), F.get("_q", F.lit(1)).alias("ci_high"))
    return sizes.join(found, _same(keys)).select(*keys, "n", "median", "ci_low", "ci_high")

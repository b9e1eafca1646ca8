"""Tests that attack a strategy's trades, the twelve of the blueprint. They only read: nothing here writes parameters, and no surface is sorted by result.

Trades have (trade_id, run, day date, at, side, r_net double) and what a test needs besides. A test that runs a strategy anew takes the runs' trades as input,
with a column that says which variant a row belongs to: running is the business of whoever has the strategy.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tidemark.functions.draws import Digests

# What the tests ask for.
GOOD_YEARS, MOST_OF_A_YEAR, MOST_AMBIGUOUS, REPLICATIONS = 0.70, 0.40, 0.20, 200
COSTS, SPREADS, SLIPPAGE = (1.0, 1.5, 2.0, 3.0), (1.25, 1.5, 2.0), (2.0, 3.0)
MANDATORY = ("RT-1", "RT-2", "RT-3", "RT-8", "RT-9", "RT-12")
#: Results in R are summed as whole billionths, so that no sum depends on the order of its rows; what differs by less than one is equal.
BILLION = 1e9
RESAMPLES = 1000


def _units(value: Column) -> Column:
    return F.round(value * BILLION).cast("long")


def _total(value: Column) -> Column:
    return F.sum(_units(value)) / BILLION


def _mean(value: Column) -> Column:
    return _total(value) / F.count(value)


def by_year(trades: DataFrame) -> DataFrame:
    """RT-1: (run, year, n, expectancy_r, total_r, of_total): of_total is the year's share of the run's whole result, null where that isn't above 0."""
    g = trades.groupBy("run", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"), _mean(F.col("r_net")).alias("expectancy_r"), _total(F.col("r_net")).alias("total_r"))
    whole = F.sum("total_r").over(W.partitionBy("run"))
    return g.withColumn("of_total", F.when(whole > 0, F.col("total_r") / whole))


def years_hold(years: DataFrame) -> DataFrame:
    """(run, good_years, most, passed) of by_year: enough years above 0, and none that makes too much of the result."""
    g = years.groupBy("run").agg((F.count_if(F.col("expectancy_r") > 0) / F.count(F.lit(1))).alias("good_years"), F.max("of_total").alias("most"))
    return g.withColumn("passed", (F.col("good_years") >= GOOD_YEARS) & F.coalesce(F.col("most") <= MOST_OF_A_YEAR, F.lit(False)))


def stressed(trades: DataFrame, cost: str, multipliers: tuple[float, ...]) -> DataFrame:
    """RT-2 to RT-4: (run, multiplier, n, expectancy_r) with a cost, in R and part of r_net once, taken so many times. For the spread the cost is what both
    sides lose to a spread that widens evenly around the mid, for slippage the ticks lost to it."""
    each = trades.withColumn("multiplier", F.explode(F.array(*(F.lit(float(m)) for m in multipliers))))
    return each.groupBy("run", "multiplier").agg(F.count(F.lit(1)).alias("n"), _mean(F.col("r_net") - (F.col("multiplier") - 1) * F.col(cost)).alias("expectancy_r"))


#: A trade is drawn so many times at most in one resample; rows of sums that a task gives out at once.
MOST_DRAWN, GIVEN_OUT = 12, 1 << 16
#: Digests that are made at once.
AT_ONCE = 1 << 14


def _poisson(words: np.ndarray) -> np.ndarray:
    """How often a trade is drawn, by a number in [0, 1) for each 32 bits: Poisson of mean 1, by its distribution function."""
    total, out = math.exp(-1), np.zeros(words.shape, np.uint8)
    for k in range(MOST_DRAWN):
        if (least := math.ceil(total * 2**32)) < 2**32:
            out += words >= np.uint32(least)
        total += math.exp(-1) / math.factorial(k + 1)
    return out


def _drawn_sums(trades: DataFrame, by: list[str], seed: int, draws: range, weights: Callable[[np.ndarray], np.ndarray], values: dict[str, Column]) -> DataFrame:
    """(by, _draw, _k, values): each whole number of a trade summed as often as weights says, a row for each draw and each row k of the weights. The weights are made of the four
    words of the digest of seed, draw and trade_id, whatever the partitioning; null where a sum has no number.

    Trades are dealt out by range, groups together, so that a file of one piece is the work of many tasks and a task has few groups; none has to fit into one. A task makes the
    digests of a batch of trades by whole arrays and gives out sums: no row is made for a draw of a trade.
    """
    spark = trades.sparkSession
    parts = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    text = F.coalesce(F.concat(F.lit(":"), F.col("trade_id").cast("string")), F.lit(""))
    dealt = trades.select(*by, "trade_id", *(v.cast("long").alias(k) for k, v in values.items())).repartitionByRange(parts, *by, "trade_id").sortWithinPartitions(*by)
    rows = dealt.select(*by, text.alias("_text"), *values)
    schema = StructType([rows.schema[k] for k in by]).add("_draw", LongType()).add("_k", LongType())
    for k in values:
        schema = schema.add(k, LongType())
    names = list(values)

    def together(n: int) -> Iterator[list[int]]:
        """Draws that are made at once for n trades: of one number of digits, and so many that whole arrays pay."""
        for _, same in groupby(draws, key=lambda d: len(str(d))):
            while some := list(islice(same, max(1, AT_ONCE // n))):
                yield some

    def changes(x: pa.Array) -> np.ndarray:
        """Where a value differs from the one before it."""
        a, b = x[1:], x[:-1]
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        return differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))

    def run(batches):
        for whole in batches:
            most = max((max(-(lim["min"] or 0), lim["max"] or 0) for lim in (pc.min_max(whole[k]).as_py() for k in names)), default=0)
            if most * MOST_DRAWN >= 2**63:
                raise OverflowError(f"{most} can't be summed {MOST_DRAWN} times")
            step = max(1, min(whole.num_rows, (2**63 - 1) // (MOST_DRAWN * most or 1)))  # no sum of a step leaves 64 bits
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                starts = np.flatnonzero(np.concatenate([[True], reduce(np.logical_or, (changes(batch[k]) for k in by), np.zeros(batch.num_rows - 1, bool))]))
                keys = [batch[k].take(pa.array(starts)) for k in by]
                numbers = [pc.fill_null(batch[k], 0).to_numpy() for k in names]
                empty = [np.add.reduceat(batch[k].is_valid().to_numpy(zero_copy_only=False).astype(np.int64), starts) == 0 for k in names]
                digests, groups, held, n = Digests(batch["_text"]), np.arange(len(starts)), [], 0
                for some in together(batch.num_rows):
                    w = weights(digests.words([f"{seed}:{draw}".encode() for draw in some])).astype(np.int64)
                    sums = [np.add.reduceat(w * x, starts, axis=2) for x in numbers]
                    held.append([x.ravel() for x in (*np.broadcast_arrays(groups, np.array(some)[:, None], np.arange(len(w))[:, None, None]), *sums)])
                    n += held[-1][0].size
                    if n >= GIVEN_OUT or some[-1] == draws[-1]:
                        of, draw, k, *found = (np.concatenate(x) for x in zip(*held))
                        found = [pa.array(x, mask=e[of]) for x, e in zip(found, empty)]
                        yield pa.RecordBatch.from_arrays([*(x.take(pa.array(of)) for x in keys), pa.array(draw), pa.array(k), *found], [*by, "_draw", "_k", *names])
                        held, n = [], 0

    return rows.mapInArrow(run, schema).groupBy(*by, "_draw", "_k").agg(*(F.sum(k).alias(k) for k in names))


def lower_bounds_of(trades: DataFrame, by: list[str], seed: int, tests: dict[str, tuple[Column, tuple[float, ...]]], resamples: int = RESAMPLES, tail: float = 0.025) -> DataFrame:
    """RT-1 to RT-4: (by, test, multiplier, n, expectancy_r, low) for each test's cost and multipliers: the expectancy with the cost taken so many times, and what it exceeds in
    all but tail of the resamples.

    A trade is drawn a Poisson number of times in each resample, which the seed, the resample and trade_id decide: the same for all tests and multipliers, so their differences
    carry no noise of resampling, and whatever the partitioning. Trades aren't gathered: each task sums what its own trades are drawn. One digest draws for four resamples, and for all tests.
    """
    costs = {f"_c{k}": cost for k, (cost, _) in enumerate(tests.values())}
    values = {"_w": F.lit(1), "_r": _units(F.col("r_net")), **{k: _units(c) for k, c in costs.items()}}
    sums = _drawn_sums(trades, by, seed, range(-(-resamples // 4)), _poisson, values).where(F.col("_draw") * 4 + F.col("_k") < resamples)
    each = [(name, c, float(m)) for c, (name, (_, multipliers)) in zip(costs, tests.items()) for m in multipliers]
    stress = lambda of: F.explode(F.array(*(F.struct(F.lit(name).alias("test"), F.lit(m).alias("multiplier"), F.col(c).alias("cost")) for name, c, m in each))).alias(of)
    means = sums.select(*by, "_w", "_r", stress("s"))
    mean = F.try_divide((F.col("_r") - (F.col("s.multiplier") - 1) * F.col("s.cost")) / BILLION, F.col("_w"))
    low = means.groupBy(*by, F.col("s.test").alias("test"), F.col("s.multiplier").alias("multiplier")).agg(F.percentile(mean, F.lit(tail)).alias("low"))
    priced = trades.withColumns(costs).select(*by, "r_net", stress("s"))
    own = priced.groupBy(*by, F.col("s.test").alias("test"), F.col("s.multiplier").alias("multiplier")).agg(F.count(F.lit(1)).alias("n"), _mean(F.col("r_net") - (F.col("s.multiplier") - 1) * F.col("s.cost")).alias("expectancy_r"))
    return own.join(low, [*by, "test", "multiplier"])


def lower_bounds(trades: DataFrame, by: list[str], seed: int, cost: Column | None = None, multipliers: tuple[float, ...] = (1.0,), resamples: int = RESAMPLES, tail: float = 0.025) -> DataFrame:
    """(by, multiplier, n, expectancy_r, low) of one cost: see lower_bounds_of."""
    return lower_bounds_of(trades, by, seed, {"": (F.lit(0.0) if cost is None else cost, multipliers)}, resamples, tail).drop("test")


def surface(variants: DataFrame, parameter: str = "parameter", value: str = "value") -> DataFrame:
    """RT-5 and RT-6: (run, parameter, value, n, expectancy_r) of trades of perturbed runs (parameters by a tenth and a fifth, the window by 5 and 15 minutes), by value."""
    g = variants.groupBy("run", F.col(parameter).alias("parameter"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"), _mean(F.col("r_net")).alias("expectancy_r"))
    return g.orderBy("run", "parameter", "value")


def without_best(trades: DataFrame, shares: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """RT-7: (run, share, n, expectancy_r) without the best trades, so many of all, rounded up."""
    n = F.count(F.lit(1)).over(W.partitionBy("run"))
    ranked = trades.withColumn("_n", n).withColumn("_k", F.row_number().over(W.partitionBy("run").orderBy(F.desc("r_net"), "trade_id")))
    each = ranked.withColumn("share", F.explode(F.array(*(F.lit(s) for s in shares)))).where(F.col("_k") > F.ceil(F.round(F.col("_n") * F.col("share"), 9)))
    return each.groupBy("run", "share").agg(F.count(F.lit(1)).alias("n"), _mean(F.col("r_net")).alias("expectancy_r"))


def pessimistic(trades: DataFrame) -> DataFrame:
    """RT-8: (run, ambiguous, expectancy_r, pessimistic_r, passed) of trades with ambiguous boolean and r_worst, the result if the stop comes first."""
    worst = F.when(F.col("ambiguous"), F.col("r_worst")).otherwise(F.col("r_net"))
    g = trades.groupBy("run").agg(F.avg(F.col("ambiguous").cast("int")).alias("ambiguous"), _mean(F.col("r_net")).alias("expectancy_r"), _mean(worst).alias("pessimistic_r"))
    return g.withColumn("passed", F.col("expectancy_r") - F.col("pessimistic_r") < MOST_AMBIGUOUS * F.abs("expectancy_r"))


def _uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that the seed and the keys decide, whatever the partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def envelope(actual: DataFrame, replications: DataFrame) -> DataFrame:
    """(run, expectancy_r, low, high, outside): the middle 95 % of the replications' expectancies (run, replication, expectancy_r). outside: by more than a billionth, so
    that a run whose replications all equal it is inside."""
    q = F.percentile("expectancy_r", F.array(F.lit(0.025), F.lit(0.975)))
    band = replications.groupBy("run").agg(q.alias("q")).select("run", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    own = actual.groupBy("run").agg(_mean(F.col("r_net")).alias("expectancy_r"))
    return own.join(band, "run").withColumn("outside", (F.col("expectancy_r") < F.col("low") - 1 / BILLION) | (F.col("expectancy_r") > F.col("high") + 1 / BILLION))


def _sides(words: np.ndarray) -> np.ndarray:
    """Once as traded or once on the other side, by whether a number in [0, 1) is below a half."""
    own = (words[0] < np.uint32(1 << 31)).astype(np.uint8)
    return np.stack([own, 1 - own])


def placebo(trades: DataFrame, seed: int, replications: int = REPLICATIONS) -> DataFrame:
    """RT-9: (run, replication, expectancy_r) with a side drawn for each trade. r_net: as traded; r_opposite: the same entry, stop and target distances on the other side."""
    sides = {"own": F.col("r_net"), "opposite": F.col("r_opposite")}
    values = {f"_{c}_{side}": x for side, r in sides.items() for c, x in (("r", _units(r)), ("n", r.isNotNull().cast("long")))}
    sums = _drawn_sums(trades, ["run"], seed, range(1, replications + 1), _sides, values)
    r, n = (F.sum(F.when(F.col("_k") == 0, F.col(f"_{c}_own")).otherwise(F.col(f"_{c}_opposite"))) for c in "rn")
    return sums.groupBy("run", F.col("_draw").cast("int").alias("replication")).agg(F.try_divide(r / BILLION, n).alias("expectancy_r"))


def random_timing(trades: DataFrame, slots: DataFrame, seed: int, replications: int = REPLICATIONS) -> DataFrame:
    """RT-10: (run, replication, expectancy_r) with an entry drawn from the day's scan window for each trade, of its side. slots: (run, day, side, slot from 0, n_slots, r_net): what an
    entry at each minute of the window would have made."""
    days = slots.groupBy("run", "day", "side").agg(F.max("n_slots").alias("_n"))
    each = trades.select("run", "day", "side", "trade_id").join(days, ["run", "day", "side"]).withColumn("replication", F.explode(F.sequence(F.lit(1), F.lit(replications))))
    drawn = each.withColumn("slot", F.floor(_uniform(seed, "replication", "trade_id") * F.col("_n")))
    return drawn.join(slots.select("run", "day", "side", "slot", "r_net"), ["run", "day", "side", "slot"]).groupBy("run", "replication").agg(_mean(F.col("r_net")).alias("expectancy_r"))


def by_regime(trades: DataFrame, days: DataFrame, value: str = "rv_ratio", parts: int = 3) -> DataFrame:
    """RT-11: (run, regime, n, expectancy_r) by terciles of a daily value (day, value); the cuts are those of all days that have one."""
    cuts = days.agg(F.percentile(value, F.array(*(F.lit(k / parts) for k in range(1, parts)))).alias("q")).first()["q"] or []  # parts - 1 numbers
    regime = reduce(lambda a, c: a + (F.col(value) > c).cast("int"), cuts, F.lit(0))
    named = days.where(F.col(value).isNotNull()).select("day", regime.alias("regime"))
    return trades.join(named, "day").groupBy("run", "regime").agg(F.count(F.lit(1)).alias("n"), _mean(F.col("r_net")).alias("expectancy_r"))


def digest(trades: DataFrame, columns: list[str]) -> DataFrame:
    """RT-12: (run, n, result_sha256): a digest of a run's trades in the order of their ids. Rows are hashed where they are; a run's digests are put in order by one
    aggregation of 32 bytes a trade."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))
    rows = trades.select("run", "trade_id", F.sha2(line, 256).alias("_h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("trade_id", "_h"))), lambda x: x["_h"]), "")
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sha2(joined, 256).alias("result_sha256"))


def ready(passed: dict[str, bool]) -> tuple[bool, list[str]]:
    """Whether the mandatory tests have passed, and which tests are absent or failed."""
    return all(passed.get(t, False) for t in MANDATORY), [t for t in (f"RT-{k}" for k in range(1, 13)) if not passed.get(t, False)]

"""Descriptive reports: session ranges (R1), volatility after quiet and busy mornings (R2), spreads and ranges by hour of the week (R5)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators.features import range_percentile, session_days, trailing_range, wilder_atr
from tidemark.operators.selection import at_ranks, quantiles
from tidemark.plans.config import FX_CORE, SessionSet
from tidemark.sources.scratch import written

R1_SESSIONS = ("pre_london", "london", "new_york")
BUCKETS = 5
SUPPRESSED, MARKED = 10, 30
_CELLS = 20_000_000


def bootstrap_ci(values: np.ndarray, seed: int, resamples: int = 2000, level: float = 0.95, statistic: Callable = np.median) -> tuple[float, float, float]:
    """(statistic of the data, low, high): percentile interval over resamples with replacement. Resamples are drawn in chunks of at most 2e7 numbers from one
    stream, so that chunking doesn't change them."""
    if not len(values):
        raise ValueError("nothing to resample")
    rng, n = np.random.default_rng(seed), len(values)
    chunk = max(1, _CELLS // n)
    stats = np.concatenate([statistic(values[rng.integers(0, n, size=(min(chunk, resamples - at), n))], axis=1) for at in range(0, resamples, chunk)])
    low, high = np.percentile(stats, [100 * (1 - level) / 2, 100 * (1 + level) / 2])
    return float(statistic(values)), float(low), float(high)


def grouped_bootstrap(rows: DataFrame, keys: list[str], value: str, seed: Column, resamples: int = 2000, least: int = SUPPRESSED, level: float = 0.95, statistic: Callable = np.median, name: str = "median") -> DataFrame:
    """(keys, n, the statistic under its name, ci_low, ci_high); groups of fewer than least values get no interval. Each group draws from a stream of its own seed.
    statistic: of an array along an axis, as numpy's are."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf["_v"].to_numpy(float))
        v = v[np.isfinite(v)]
        point, low, high = bootstrap_ci(v, int(pdf["_seed"].iloc[0]), resamples, level, statistic) if len(v) >= least else (float(statistic(v)) if len(v) else None, None, None)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [len(v)], name: [point], "ci_low": [low], "ci_high": [high]})

    fed = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), seed.alias("_seed"))
    return fed.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + f", n long, {name} double, ci_low double, ci_high double")


def note(n: str = "n") -> Column:
    return F.when(F.col(n) < SUPPRESSED, "suppressed").when(F.col(n) < MARKED, "small sample").otherwise("")


def hour_of_week(bars: DataFrame, window: int = 60) -> DataFrame:
    """Bars with spread, weekday (1: Monday) and hour in London, UTC year, and the range of the last window bars."""
    rows = trailing_range(bars, window).where("spread_twa is not null")
    return rows.withColumn("weekday", F.expr(T.iso_weekday("ts_utc_ns"))).withColumn("hour", F.expr(T.local_hour("ts_utc_ns"))).withColumn("year", F.expr(T.utc_year("ts_utc_ns")))


def r5_by_hour(bars: DataFrame, window: int = 60) -> DataFrame:
    """(instrument, weekday, hour, n, median_spread, n_range, median_range, ratio)."""
    g = hour_of_week(bars, window).groupBy("instrument", "weekday", "hour").agg(F.count(F.lit(1)).alias("n"), F.percentile("spread_twa", F.lit(0.5)).alias("median_spread"), F.count("range_60m").alias("n_range"), F.percentile("range_60m", F.lit(0.5)).alias("median_range"))
    return g.withColumn("ratio", F.try_divide("median_spread", F.nullif("median_range", F.lit(0.0))))


def r5_by_year(bars: DataFrame) -> DataFrame:
    rows = bars.where("spread_twa is not null").select("instrument", F.expr(T.utc_year("ts_utc_ns")).alias("year"), "spread_twa")
    return quantiles(rows, ["instrument", "year"], "spread_twa", [0.5]).select("instrument", "year", "n", F.col("q")[0].alias("median_spread"))


def r5_intervals(bars: DataFrame, resamples: int = 500, window: int = 60) -> DataFrame:
    """Spread and range medians by hour of the week with bootstrap intervals, as one row for each series."""
    rows = hour_of_week(bars, window)
    seed = F.lit(20260913) + F.col("weekday") * 100 + F.col("hour")
    keys = ["instrument", "weekday", "hour"]
    spread = grouped_bootstrap(rows, keys, "spread_twa", seed, resamples).withColumn("series", F.lit("spread"))
    return spread.unionByName(grouped_bootstrap(rows, keys, "range_60m", seed + 10_000, resamples).withColumn("series", F.lit("range_60m")))


def r5_year_intervals(bars: DataFrame, resamples: int = 500) -> DataFrame:
    """Spread medians by year with bootstrap intervals, in the columns of r5_intervals; a year draws from a stream of its own."""
    rows = bars.where("spread_twa is not null").withColumn("year", F.expr(T.utc_year("ts_utc_ns")))
    return grouped_bootstrap(rows, ["instrument", "year"], "spread_twa", F.lit(20260913 + 20_000) + F.col("year"), resamples).withColumn("series", F.lit("spread"))


def session_ratios(bars: DataFrame, atr_n: int = 1440, sessions: SessionSet = FX_CORE, names: tuple[str, ...] = R1_SESSIONS) -> DataFrame:
    """(instrument, day, session, range, atr, ratio) of days that are over and have bars in the session; days without a finite ratio are left out."""
    with_atr = session_days(wilder_atr(bars, atr_n), sessions, list(names), ("atr_bars", "atr")).where("n_bars > 0 and observed")
    return with_atr.withColumn("ratio", F.try_divide("range", F.nullif("atr", F.lit(0.0)))).where("ratio is not null").select("instrument", "day", "session", "range", "atr", "ratio")


def _quartiles(value: str, name: str) -> list[Column]:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [q[k].alias(f"{p}_{name}") for k, p in enumerate(("q1", "median", "q3"))]


def r1_marginals(ratios: DataFrame) -> DataFrame:
    """(instrument, session, grouping, key, n, quartiles of range and ratio) by year and by weekday (0: Monday) of the trading day."""
    cell = F.explode(F.array(F.struct(F.lit("year").alias("grouping"), F.year("day").alias("key")), F.struct(F.lit("weekday").alias("grouping"), F.weekday("day").alias("key"))))
    return ratios.withColumn("_c", cell).select("*", "_c.*").groupBy("instrument", "session", "grouping", "key").agg(F.count(F.lit(1)).alias("n"), *_quartiles("range", "range"), *_quartiles("ratio", "ratio"))


def r1_intervals(ratios: DataFrame, resamples: int = 2000) -> DataFrame:
    cell = F.explode(F.array(F.struct(F.lit("year").alias("grouping"), F.year("day").alias("key")), F.struct(F.lit("weekday").alias("grouping"), F.weekday("day").alias("key"))))
    rows = ratios.withColumn("_c", cell).select("*", "_c.*")
    offset = F.element_at(F.create_map(*(F.lit(x) for k, s in enumerate(R1_SESSIONS) for x in (s, k * 100_000))), F.col("session"))
    seed = F.lit(20260914) + F.coalesce(offset, F.lit(0)) + F.when(F.col("grouping") == "weekday", 50_000).otherwise(0) + F.col("key")
    keys = ["instrument", "session", "grouping", "key"]
    price = grouped_bootstrap(rows, keys, "range", seed, resamples).withColumn("unit", F.lit("price"))
    return price.unionByName(grouped_bootstrap(rows, keys, "ratio", seed + 1, resamples).withColumn("unit", F.lit("atr")))


def _few_ends(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, _ends) by a fold over a group's distinct values with their counts, which must be few."""
    counts = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    listed = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_l"), F.sum("_c").alias("_n"))
    zero = F.struct(F.lit(0).cast("long").alias("c"), F.array().cast("array<double>").alias("o"))

    def step(a, x):
        c = a["c"] + x["_c"]
        full = (F.size(a["o"]) < BUCKETS - 1) & (c >= F.col("_n") / BUCKETS)
        return F.struct(F.when(full, 0).otherwise(c).cast("long").alias("c"), F.when(full, F.concat(a["o"], F.array(x["_v"].cast("double")))).otherwise(a["o"]).alias("o"))

    return listed.select(*keys, F.aggregate("_l", zero, step)["o"].alias("_ends"))


def _searched_ends(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, _ends), each end by selection: the value at the rank that fills the bucket, and how many rows lie up to it, from which the next bucket begins."""
    state = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_taken": F.lit(0).cast("long"), "_ends": F.array().cast("array<double>")})
    for _ in range(BUCKETS - 1):
        state = state.withColumn("rank", F.expr(f"(_n + {BUCKETS - 1}) div {BUCKETS} + _taken - 1"))
        found = at_ranks(rows, keys, value, state.where("rank < _n").select(*keys, "rank")).select(*(F.col(k).alias(f"_of_{k}") for k in keys), "value", (F.col("below") + F.col("equal")).alias("_up_to"))
        both = state.join(found, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left")
        state = written(both.select(*keys, "_n", F.coalesce("_up_to", "_n").alias("_taken"), F.when(F.col("value").isNull(), F.col("_ends")).otherwise(F.concat("_ends", F.array("value"))).alias("_ends")), "ends")
    return state.select(*keys, "_ends")


def quintiles(rows: DataFrame, value: str, keys: list[str], out: str = "bucket", few: bool = False) -> DataFrame:
    """Buckets 0 to 4 in ascending order that never part equal values: a bucket is full once it has a fifth of the rows, and the last takes the rest. few: a group has some
    thousands of distinct values at most (percentiles of n days have n + 1), and they are folded in one plan; else the ends are searched for, whatever the groups' size."""
    rows = rows.where(F.col(value).isNotNull())
    ends = (_few_ends if few else _searched_ends)(rows, value, keys)
    bucket = F.size(F.filter("_ends", lambda e: F.col(value) > e))
    return rows.join(ends, keys).withColumn(out, bucket).drop("_ends")


def r2_days(bars: DataFrame, atr_n: int = 1440, pct_n: int = 60, sessions: SessionSet = FX_CORE) -> DataFrame:
    """(instrument, day, pct, ratio, bucket): the morning's percentile, London's range in ATRs, and the percentile's bucket over all days."""
    days = session_days(wilder_atr(bars, atr_n), sessions, ["pre_london", "london"], ("atr_bars", "atr"))
    known = range_percentile(days, pct_n).where("n_bars > 0 and observed")
    ratio = F.when(F.col("session") == "london", F.try_divide("range", F.nullif("atr", F.lit(0.0))))
    both = known.groupBy("instrument", "day").agg(F.max(ratio).alias("ratio"), F.max(F.when(F.col("session") == "pre_london", F.col("pct"))).alias("pct")).where("ratio is not null and pct is not null")
    # one row for each instrument and day: dealt out once, so that both readers of the rows share the exchange
    return quintiles(both.repartition("instrument"), "pct", ["instrument"], few=True)


def r2_buckets(days: DataFrame) -> DataFrame:
    """(instrument, year (null: pooled), bucket, n, pct_min, pct_max, quartiles): all five buckets, empty ones too."""
    each = days.withColumn("year", F.explode(F.array(F.lit(None).cast("int"), F.year("day"))))
    cells = []
    for k in range(BUCKETS):
        of = lambda c, k=k: F.when(F.col("bucket") == k, F.col(c))
        q = F.percentile(of("ratio"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        cells.append(F.struct(F.lit(k).alias("bucket"), F.count(of("ratio")).alias("n"), F.min(of("pct")).alias("pct_min"), F.max(of("pct")).alias("pct_max"), F.get(q, 0).alias("q1_ratio"), F.get(q, 1).alias("median_ratio"), F.get(q, 2).alias("q3_ratio")))
    return each.groupBy("instrument", "year").agg(F.array(*cells).alias("c")).select("instrument", "year", F.explode("c").alias("c")).select("instrument", "year", "c.*")


def r2_intervals(days: DataFrame, resamples: int = 2000) -> DataFrame:
    rows = days.withColumn("year", F.explode(F.array(F.lit(0), F.year("day"))))
    seed = F.lit(20260914) + F.col("bucket") * 1000 + F.when(F.col("year") == 0, 0).otherwise(F.lit(100_000) + F.col("year") - 2000)
    return grouped_bootstrap(rows, ["instrument", "year", "bucket"], "ratio", seed, resamples)


def _quartered(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds q1, median, q3, and whether a value lies within 1.5 quartile ranges of the box."""
    q = quantiles(rows, keys, value, [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q")
    q = q.select(*keys, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3")).withColumn("_d", 1.5 * (F.col("q3") - F.col("q1")))
    v = F.col(value)
    return rows.join(q, keys).withColumn("_inside", (v >= F.col("q1") - F.col("_d")) & (v <= F.col("q3") + F.col("_d"))).drop("_d")


def box_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, q1, median, q3, low, high, n_outliers): whiskers end at the last points within 1.5 quartile ranges."""
    inside, v = F.col("_inside"), F.col(value)
    return _quartered(rows, keys, value).groupBy(*keys, "q1", "median", "q3").agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.count_if(~inside).alias("n_outliers"))


def outliers(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): a row for each point beyond the whiskers."""
    return _quartered(rows, keys, value).where("not _inside").select(*keys, value)

"""Ticks to one-minute bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.sources.ticks import month_gaps, with_month


def resample(ticks: DataFrame, width_ns: int = T.MINUTE) -> DataFrame:
    """Bars of the minutes that have ticks. Ticks are ordered by time and row_sequence; bid and ask have their own highs and lows; the
    time-weighted spread counts each spread until the next tick, the last until the minute's end, over the time since the first tick.

    One shuffle, by instrument and minute: the window and the aggregation share it. prev_gap_ns is added by with_gaps.
    """
    order = F.struct("ts_utc_ns", "row_sequence")
    minute = W.partitionBy("instrument", "minute").orderBy("ts_utc_ns", "row_sequence")
    t = ticks.withColumn("minute", F.expr(f"ts_utc_ns - pmod(ts_utc_ns, {width_ns})")).withColumn("spread", F.col("ask") - F.col("bid"))
    t = t.withColumn("held", F.coalesce(F.lead("ts_utc_ns").over(minute), F.col("minute") + width_ns) - F.col("ts_utc_ns"))
    sides = [f(c).alias(f"{c}_{n}") for c in ("bid", "ask") for n, f in (("o", lambda c: F.min_by(c, order)), ("h", F.max), ("l", F.min), ("c", lambda c: F.max_by(c, order)))]
    bars = t.groupBy("instrument", F.col("minute").alias("ts_utc_ns")).agg(
        *sides, F.count(F.lit(1)).cast("int").alias("tick_count"), F.min(t["ts_utc_ns"]).alias("first_tick_ns"), F.max(t["ts_utc_ns"]).alias("last_tick_ns"),
        F.min_by("spread", order).alias("spread_open"), F.max("spread").alias("spread_max"), F.sum(F.col("spread") * F.col("held")).alias("_weighted"))
    return bars.withColumn("spread_twa", F.col("_weighted") / (F.col("ts_utc_ns") + width_ns - F.col("first_tick_ns"))).drop("_weighted")


def with_gaps(bars: DataFrame, continuous: bool = False) -> DataFrame:
    """prev_gap_ns: from the previous bar's last tick to the first. Stored months begin with null; continuous goes on across months, whose last ticks are carried
    over by a table of one row a month."""
    if not continuous:
        return month_gaps(with_month(bars))
    month = ["instrument", "year", "month"]
    rows = with_month(bars)
    ends = rows.groupBy(*month).agg(F.max("last_tick_ns").alias("_end"))
    before = ends.select(*month, F.lag("_end").over(W.partitionBy("instrument").orderBy("year", "month")).alias("_before"))
    own = F.lag("last_tick_ns").over(W.partitionBy(*month).orderBy("ts_utc_ns"))
    return rows.join(before, month).withColumn("prev_gap_ns", F.col("first_tick_ns") - F.coalesce(own, F.col("_before"))).drop("_before")


def resample_report(ticks: DataFrame, bars: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """(instrument, months_expected, months_present, months_missing, ticks, bars, minutes_absent) of [start, end)."""
    months = f"(cast(months_between(trunc({T.instant(str(end_ns - 1))}, 'MM'), trunc({T.instant(str(start_ns))}, 'MM')) as int) + 1)"
    t = ticks.groupBy("instrument").agg(F.countDistinct(F.expr(T.month_key("ts_utc_ns"))).alias("months_present"), F.count(F.lit(1)).alias("ticks"))
    b = bars.groupBy("instrument").agg(F.count(F.lit(1)).alias("bars"))
    both = t.join(b, "instrument", "left").withColumn("bars", F.coalesce("bars", F.lit(0))).withColumn("months_expected", F.expr(months))
    return both.select("instrument", "months_expected", "months_present", (F.col("months_expected") - F.col("months_present")).alias("months_missing"), "ticks", "bars", (F.lit((end_ns - start_ns) // T.MINUTE) - F.col("bars")).alias("minutes_absent"))

"""Further features and reports: returns over several bars, earlier days and weeks, breaks of levels, and the reports on breaks (R3), on the hours of
daily extremes (R4) and on volatility by year (R6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators.events import Params, detect
from tidemark.operators.features import _rows, realised_volatility, session_days, wilder_atr, with_day, with_mid
from tidemark.operators.sequence import trailing
from tidemark.operators.sessions import session_windows
from tidemark.plans.config import FX_CORE, SessionSet

KEY = ["instrument"]
Z95 = 1.959963984540054  # fixed value: the normal distribution's 97.5th percentile


def returns(bars: DataFrame, ks: tuple[int, ...] = (1, 5, 15, 60), gap_ns: int = 5 * T.MINUTE) -> DataFrame:
    """ret_{k}m: log return of the mid over k bars; of one bar, null if a gap longer than gap_ns is before it."""

    def make(w):
        out = {f"ret_{k}m": F.log("mid") - F.log(F.lag("mid", k).over(w)) for k in ks}
        if 1 in ks:
            out["ret_1m"] = F.when(~(F.coalesce("prev_gap_ns", F.lit(0)) > gap_ns), out["ret_1m"])
        return out

    return trailing(_rows(with_mid(bars)), KEY, max(ks), make)


def calendar(bars: DataFrame) -> DataFrame:
    """hour_of_day_london, day_of_week_trading (1: Monday) and minutes_into_trading_day."""
    days = with_day(bars)
    return days.withColumns({"hour_of_day_london": F.expr(T.local_hour("ts_utc_ns")), "day_of_week_trading": F.expr("weekday(day) + 1"), "minutes_into_trading_day": F.expr(f"(ts_utc_ns - {T.day_start('day')}) div {T.MINUTE}")})


def _earlier_days(rows: DataFrame, value: str, by: list[str], days: int) -> DataFrame:
    """Adds _before, the values of the same slot (by) on the days before; a day's own are never in it. One row for each slot and day holds that day's
    values, so the window is over days, and is joined back to the bars."""
    slot = rows.where(F.col(value).isNotNull()).groupBy("instrument", *by, "day").agg(F.collect_list(value).alias("_v"))
    order = F.expr("datediff(day, date'1970-01-01')")
    w = W.partitionBy("instrument", *by).orderBy(order).rangeBetween(-days, -1)
    before = slot.withColumn("_before", F.flatten(F.collect_list("_v").over(w))).drop("_v")
    return rows.join(before, ["instrument", *by, "day"], "left")


def rv_ratio(bars: DataFrame, n: int = 60, gap_ns: int = 5 * T.MINUTE, days: int = 28) -> DataFrame:
    """rv_60m over its median at the same London hour on earlier trading days only (days: how many calendar days back, 28 for 20 trading days)."""
    rows = with_day(realised_volatility(bars, n, gap_ns)).withColumn("hour", F.expr(T.local_hour("ts_utc_ns")))
    slots = _earlier_days(rows, "rv_60m", ["hour"], days)
    return slots.withColumn("rv_ratio", F.try_divide("rv_60m", F.nullif(_array_median("_before"), F.lit(0.0)))).drop("_before", "hour", "day")


def _array_median(column: str) -> Column:
    a, n = F.array_sort(column), F.size(column)
    at = lambda k: F.get(a, k.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def spread_percentile(bars: DataFrame, days: int = 28) -> DataFrame:
    """spread_pct: the share of spreads at the same hour of the week on earlier trading days that are smaller."""
    rows = with_day(bars).withColumns({"weekday": F.expr("weekday(day) + 1"), "hour": F.expr(T.local_hour("ts_utc_ns"))})
    slots = _earlier_days(rows, "spread_twa", ["weekday", "hour"], days)
    smaller = F.size(F.filter("_before", lambda x: x < F.col("spread_twa")))
    return slots.withColumn("spread_pct", F.when(F.size("_before") > 0, smaller / F.size("_before"))).drop("_before", "weekday", "hour", "day")


def close_position(bars: DataFrame, session: str = "pre_london", sessions: SessionSet = FX_CORE) -> DataFrame:
    """(instrument, day, close_position): where in the session's range its last mid is."""
    days = session_days(bars, sessions, [session])
    inside = with_day(with_mid(bars)).join(days.select("instrument", "day", "start_ns", "end_ns"), ["instrument", "day"]).where("ts_utc_ns >= start_ns and ts_utc_ns < end_ns")
    close = inside.groupBy("instrument", "day").agg(F.max_by("mid", "ts_utc_ns").alias("close"))
    return days.join(close, ["instrument", "day"]).select("instrument", "day", F.try_divide(F.col("close") - F.col("low"), F.nullif("range", F.lit(0.0))).alias("close_position"))


def previous_days(bars: DataFrame) -> DataFrame:
    """Adds prev_day_high, _low, _close of the last trading day with bars and prev_week_high, _low of the last trading week with bars."""
    rows = with_day(with_mid(bars)).withColumn("week", F.expr("date_sub(day, cast(pmod(weekday(day) + 2, 7) as int))"))
    daily = rows.groupBy("instrument", "day", "week").agg(F.max("mid").alias("h"), F.min("mid").alias("l"), F.max_by("mid", "ts_utc_ns").alias("c"))
    w = W.partitionBy("instrument").orderBy("day")
    day = daily.select("instrument", "day", *(F.lag(c).over(w).alias(f"prev_day_{n}") for c, n in (("h", "high"), ("l", "low"), ("c", "close"))))
    v = W.partitionBy("instrument").orderBy("week")
    week = daily.groupBy("instrument", "week").agg(F.max("h").alias("h"), F.min("l").alias("l")).select("instrument", "week", F.lag("h").over(v).alias("prev_week_high"), F.lag("l").over(v).alias("prev_week_low"))
    return rows.join(day, ["instrument", "day"]).join(week, ["instrument", "week"]).drop("week", "day")


def distance(level: str, atr: str = "atr_bars") -> Column:
    """Signed, in ATRs: mid less level."""
    return F.try_divide(F.col("mid") - F.col(level), F.nullif(atr, F.lit(0.0)))


def session_state(bars: DataFrame, sessions: SessionSet = FX_CORE) -> DataFrame:
    """Adds states, a map from each session that holds the bar to the nanoseconds since its start."""
    days = session_windows(with_day(bars).select("day").distinct(), sessions).groupBy("day").agg(F.collect_list(F.struct("session", "start_ns", "end_ns")).alias("_w"))
    t = F.col("ts_utc_ns")
    inside = F.filter("_w", lambda w: (t >= w["start_ns"]) & (t < w["end_ns"]))
    return with_day(bars).join(days, "day").withColumn("states", F.map_from_entries(F.transform(inside, lambda w: F.struct(w["session"], t - w["start_ns"])))).drop("_w", "day")


def break_state(rows: DataFrame, level: str, buffer_atr: float = 0.1, window: int = 60, above: bool = True) -> DataFrame:
    """Adds, from rows with rn, day, mid, atr_bars and a level column: broke (the mid is beyond level and buffer for the first time that day) and
    reentered, known only window bars after a break and so shown there: whether the mid came back to the level by then."""
    sign = 1 if above else -1
    beyond = (F.col("mid") - F.col(level)) * sign > buffer_atr * F.col("atr_bars")
    day = W.partitionBy("instrument", "day").orderBy("rn")
    first = rows.withColumn("_beyond", F.coalesce(beyond, F.lit(False))).withColumn("broke", F.col("_beyond") & (F.sum(F.col("_beyond").cast("int")).over(day) == 1))

    def make(w):
        since = F.collect_list("mid").over(w.rowsBetween(-(window - 1), 0))
        at = F.lag(level, window).over(w)
        return {"reentered": F.when(F.lag("broke", window).over(w), F.exists(since, lambda m: (m - at) * sign <= 0))}

    return trailing(first.drop("_beyond"), KEY, window, make)


def reentry_state(rows: DataFrame, level: str, buffer_atr: float = 0.1, window: int = 60, above: bool = True) -> DataFrame:
    """(rows' columns, reentry_state): whether a break of window bars before has been taken back since; null on bars that far from no break, and on the
    last bars before a window is over, so that nothing is known before it can be."""
    return break_state(rows, level, buffer_atr, window, above).drop("broke").withColumnRenamed("reentered", "reentry_state")


def wilson(hits: str, n: str) -> tuple[Column, Column]:
    """The 95 % score interval of a proportion."""
    p, m = F.col(hits) / F.col(n), F.col(n)
    centre, spread = (p + Z95**2 / (2 * m)) / (1 + Z95**2 / m), Z95 * F.sqrt(p * (1 - p) / m + Z95**2 / (4 * m * m)) / (1 + Z95**2 / m)
    return centre - spread, centre + spread


def break_and_hold(bars: DataFrame, p: Params = Params(), after: tuple[int, ...] = (30, 60, 120), sessions: SessionSet = FX_CORE) -> DataFrame:
    """R3: (instrument, year, direction, bars_after, n, held, share, low, high): how often the mid is still beyond the morning's extreme that many
    present bars after a break. Breaks with fewer bars after them are left out."""
    rows = with_mid(wilder_atr(bars, p.atr_n)).select("instrument", "ts_utc_ns", "rn", "mid")
    levels = session_days(bars, sessions, [p.morning]).select("instrument", F.col("day").alias("trading_day"), "high", "low")
    breaks = detect(bars, p, sessions).where("context = 'C-B'").join(rows.select("instrument", "ts_utc_ns", "rn"), ["instrument", "ts_utc_ns"]).join(levels, ["instrument", "trading_day"])
    at = breaks.withColumn("bars_after", F.explode(F.array(*(F.lit(k) for k in after)))).withColumn("then", F.col("rn") + F.col("bars_after"))
    seen = at.join(rows.select("instrument", F.col("rn").alias("then"), "mid"), ["instrument", "then"])
    held = F.when(F.col("direction") == "long", F.col("mid") > F.col("high")).otherwise(F.col("mid") < F.col("low"))
    g = seen.groupBy("instrument", F.year("trading_day").alias("year"), "direction", "bars_after").agg(F.count(F.lit(1)).alias("n"), F.count_if(held).alias("held"))
    low, high = wilson("held", "n")
    return g.withColumn("share", F.col("held") / F.col("n")).withColumn("low", low).withColumn("high", high)


def extreme_hours(bars: DataFrame) -> DataFrame:
    """R4: (instrument, year, weekday, closed, extreme, hour, n, share, low, high): the London hour of each trading day's high and low (the first, on ties),
    split by whether the day closed above its open. Shares are of the year's, weekday's and close's days, each with a score interval."""
    rows = with_day(with_mid(bars))
    day = rows.groupBy("instrument", "day").agg(F.min_by("ts_utc_ns", F.struct(-F.col("mid"), "ts_utc_ns")).alias("high"), F.min_by("ts_utc_ns", F.struct("mid", "ts_utc_ns")).alias("low"), F.min_by("mid", "ts_utc_ns").alias("o"), F.max_by("mid", "ts_utc_ns").alias("c"))
    each = day.select("instrument", F.year("day").alias("year"), F.expr("weekday(day) + 1").alias("weekday"), F.when(F.col("c") > F.col("o"), "up").otherwise("down").alias("closed"), F.explode(F.array(*(F.struct(F.lit(x).alias("extreme"), F.col(x).alias("at")) for x in ("high", "low")))).alias("x")).select("*", "x.*")
    keys = ["instrument", "year", "weekday", "closed", "extreme"]
    g = each.groupBy(*keys, F.expr(T.local_hour("at")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    total = g.withColumn("of", F.sum("n").over(W.partitionBy(*keys)))
    low, high = wilson("n", "of")
    return total.withColumn("share", F.col("n") / F.col("of")).withColumn("low", low).withColumn("high", high)


def volatility_by_year(bars: DataFrame, n: int = 60, gap_ns: int = 5 * T.MINUTE) -> DataFrame:
    """R6: (instrument, year, n, quartiles of rv, ratio of the median to the year before's)."""
    rows = realised_volatility(bars, n, gap_ns).where("rv_60m is not null").withColumn("year", F.expr(T.utc_year("ts_utc_ns")))
    q = F.percentile("rv_60m", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = rows.groupBy("instrument", "year").agg(F.count(F.lit(1)).alias("n"), q.alias("q")).select("instrument", "year", "n", *(F.col("q")[k].alias(f"{name}_rv") for k, name in enumerate(("q1", "median", "q3"))))
    w = W.partitionBy("instrument").orderBy("year")
    before = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("median_rv").over(w))
    return g.withColumn("to_year_before", F.try_divide("median_rv", F.nullif(before, F.lit(0.0))))

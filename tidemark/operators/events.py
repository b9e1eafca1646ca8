"""Session-break events of a trading day, their counts by year, and the gate on those counts.

C-A: the morning's range percentile is low. C-D: it is high. C-B: in the first London hours the mid breaks the morning's extreme by a share of the
ATR, once for each direction. C-C: within the next bars it comes back.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.features import range_percentile, session_days, wilder_atr, with_day, with_mid
from tidemark.plans.config import FX_CORE, SessionSet

EVENTS = "instrument string, context string, trading_day date, direction string, ts_utc_ns long, detail map<string,double>"


@dataclass(frozen=True)
class Params:
    range_pct_max: float = 0.33
    range_pct_min: float = 0.67
    break_buffer_atr: float = 0.10
    reentry_buffer_atr: float = 0.05
    reentry_window_bars: int = 60
    atr_n: int = 1440
    pct_n: int = 60
    morning: str = "pre_london"
    opening: str = "london_open_window"


def morning_days(bars: DataFrame, p: Params = Params(), sessions: SessionSet = FX_CORE) -> DataFrame:
    """(instrument, day, high, low, pct, morning_end, open_start, open_end, excluded) of every calendar day."""
    days = range_percentile(session_days(bars, sessions, [p.morning, p.opening]), p.pct_n)
    m, o = days.where(F.col("session") == p.morning), days.where(F.col("session") == p.opening)
    known = F.col("observed")
    m = m.select("instrument", "day", F.when(known, F.col("high")).alias("high"), F.when(known, F.col("low")).alias("low"), "pct", F.col("end_ns").alias("morning_end"), F.col("partial").alias("_pm"))
    o = o.select("instrument", "day", F.col("start_ns").alias("open_start"), F.col("end_ns").alias("open_end"), F.col("partial").alias("_po"))
    return m.join(o, ["instrument", "day"]).withColumn("excluded", F.lit(sessions.exclude_partial) & (F.col("_pm") | F.col("_po"))).drop("_pm", "_po")


def detect(bars: DataFrame, p: Params = Params(), sessions: SessionSet = FX_CORE) -> DataFrame:
    """All events (instrument, context, trading_day, direction, ts_utc_ns, detail)."""
    days = morning_days(bars, p, sessions).where("not excluded")
    rows = with_day(with_mid(wilder_atr(bars, p.atr_n))).select("instrument", "day", "ts_utc_ns", "rn", "mid", "atr_bars")
    percentile = F.create_map(F.lit("range_pct"), F.col("pct"))
    ranked = days.where("pct is not null").withColumn("context", F.explode(F.array_compact(F.array(F.when(F.col("pct") <= p.range_pct_max, "C-A"), F.when(F.col("pct") >= p.range_pct_min, "C-D")))))
    quiet = ranked.select("instrument", "context", F.col("day").alias("trading_day"), F.lit("none").alias("direction"), F.col("morning_end").alias("ts_utc_ns"), percentile.alias("detail"))
    opening = rows.join(days.where("high is not null and low is not null"), ["instrument", "day"]).where("ts_utc_ns >= open_start and ts_utc_ns < open_end and atr_bars is not null")
    buffer = p.break_buffer_atr * F.col("atr_bars")
    sides = F.array_compact(F.array(F.when(F.col("mid") > F.col("high") + buffer, "long"), F.when(F.col("mid") < F.col("low") - buffer, "short")))
    breaks = opening.withColumn("direction", F.explode(sides)).groupBy("instrument", "day", "direction").agg(F.min_by(F.struct("ts_utc_ns", "rn", "mid", "atr_bars", "high", "low"), "ts_utc_ns").alias("b")).select("instrument", "day", "direction", "b.*")
    broke = breaks.select("instrument", F.lit("C-B").alias("context"), F.col("day").alias("trading_day"), "direction", "ts_utc_ns", F.create_map(F.lit("mid"), F.col("mid"), F.lit("atr_bars"), F.col("atr_bars")).alias("detail"))
    # the bars after a break, by their numbers: a join on equal keys, since a break looks at a fixed number of bars
    after = breaks.withColumn("next", F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + p.reentry_window_bars)))
    back = after.join(rows.select("instrument", F.col("rn").alias("next"), F.col("mid").alias("later")), ["instrument", "next"])
    margin = p.reentry_buffer_atr * F.col("atr_bars")
    back = back.where(F.when(F.col("direction") == "long", F.col("later") <= F.col("high") - margin).otherwise(F.col("later") >= F.col("low") + margin))
    returned = back.select("instrument", "day", "direction", "ts_utc_ns", "atr_bars").distinct().select("instrument", F.lit("C-C").alias("context"), F.col("day").alias("trading_day"), "direction", "ts_utc_ns", F.create_map(F.lit("break_atr_bars"), F.col("atr_bars")).alias("detail"))
    return quiet.unionByName(broke).unionByName(returned)


def eligible_days(bars: DataFrame, p: Params = Params(), sessions: SessionSet = FX_CORE) -> DataFrame:
    """(instrument, day) with a percentile, a high and a low, and an ATR on some bar; partial days count."""
    has_atr = with_day(wilder_atr(bars, p.atr_n)).where("atr_bars is not null").select("instrument", "day").distinct()
    return morning_days(bars, p, sessions).where("pct is not null and high is not null and low is not null").join(has_atr, ["instrument", "day"], "left_semi").select("instrument", "day")


SINGLE = ("C-A", "C-B", "C-C", "C-D")
#: In the order in which ties between them are decided.
BOTH = ("C-A∩C-B", "C-A∩C-C", "C-D∩C-B", "C-D∩C-C")
CONTEXTS = SINGLE + BOTH


def counts_by_year(events: DataFrame, years: DataFrame) -> DataFrame:
    """(instrument, year, context, n) for every year of years (instrument, year): distinct (day, direction) of each context, and of breaks and returns on
    days that are quiet or busy."""
    once = events.select("instrument", F.col("trading_day").alias("day"), "context", "direction").distinct()
    w = W.partitionBy("instrument", "day")
    has = lambda kind: F.max(F.when(F.col("context") == kind, True)).over(w)
    move = F.col("context").isin("C-B", "C-C")
    named = F.array_compact(F.array(F.col("context"), *(F.when(move & F.col(f"_{kind}"), F.concat(F.lit(f"{kind}∩"), "context")) for kind in ("C-A", "C-D"))))
    tagged = once.withColumns({f"_{kind}": has(kind) for kind in ("C-A", "C-D")}).select("instrument", F.year("day").alias("year"), F.explode(named).alias("context"))
    every = tagged.groupBy("instrument", "year", "context").agg(F.count(F.lit(1)).alias("n"))
    spine = years.withColumn("context", F.explode(F.array(*(F.lit(c) for c in CONTEXTS))))
    return spine.join(every, ["instrument", "year", "context"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def weekday_days(spark, first_year: int, last_year: int) -> DataFrame:
    """(year, n): trading days from Monday to Friday."""
    return spark.sql(f"select year(d) as year, count_if(weekday(d) < 5) as n from (select explode(sequence(date'{first_year}-01-01', date'{last_year}-12-31')) as d) group by 1")


def weekdays_in(years: DataFrame) -> DataFrame:
    """Adds n to rows with a year: its trading days from Monday to Friday. A year of d days has 5 in each of its 52 weeks and one for each weekday over."""
    first = F.make_date("year", F.lit(1), F.lit(1))
    over = F.date_diff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), first) - 364
    return years.withColumn("n", F.lit(260) + (F.weekday(first) < 5).cast("int") + F.when((over == 2) & (F.weekday(F.date_add(first, 1)) < 5), 1).otherwise(0))


def admissible_years(months: DataFrame, findings: DataFrame, least: float = 0.95) -> DataFrame:
    """(instrument, year, months_ratio, errors, admissible). months: (instrument, year, month) that have data; errors: findings of that severity."""
    present = months.distinct().groupBy("instrument", "year").agg((F.count(F.lit(1)) / 12).alias("months_ratio"))
    errors = findings.where("severity = 'ERROR' and count > 0").groupBy("instrument", "year").agg(F.count(F.lit(1)).alias("errors"))
    both = present.join(errors, ["instrument", "year"], "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    return both.withColumn("admissible", (F.col("months_ratio") >= least) & (F.col("errors") == 0))


def gate(counts: DataFrame, admissible: DataFrame, widened: bool = False, min_years: int = 12) -> DataFrame:
    """(instrument, n_years, narrowest, median, p10, decision). counts: (instrument, year, context, n); only admissible years count, with zeros.

    The intersection with the lowest median (first listed on ties) decides: a median of 100 a year with a tenth percentile of 60 goes on, one of 100
    alone goes on with a warning, from 40 on the contexts are to be widened, and below that too, or, if they have been, another instrument is to be considered.
    """
    good = counts.where(F.col("context").isin(*BOTH)).join(admissible.where("admissible").select("instrument", "year"), ["instrument", "year"])
    place = F.array_position(F.array(*(F.lit(c) for c in BOTH)), F.col("context"))
    per = good.groupBy("instrument", "context").agg(F.count(F.lit(1)).alias("n_years"), F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.1)).alias("p10"))
    worst = per.groupBy("instrument").agg(F.min_by(F.struct("context", "n_years", "median", "p10"), F.struct("median", place)).alias("w")).select("instrument", F.col("w.context").alias("narrowest"), "w.n_years", "w.median", "w.p10")
    every = counts.select("instrument").distinct().join(worst, "instrument", "left").withColumn("n_years", F.coalesce("n_years", F.lit(0)))
    m = F.col("median")
    decision = F.when(F.col("n_years") < min_years, INSUFFICIENT).when((m >= 100) & (F.col("p10") >= 60), PROCEED).when(m >= 100, UNSTABLE).when((m >= 40) | F.lit(not widened), WIDEN).otherwise(FALLBACK)
    measured = F.col("n_years") >= min_years
    return every.select("instrument", "n_years", *(F.when(measured, F.col(c)).alias(c) for c in ("narrowest", "median", "p10")), decision.alias("decision"))


# What the gate can say.
INSUFFICIENT, PROCEED, UNSTABLE = "INSUFFICIENT_DATA", "PROCEED_GBPUSD", "PROCEED_GBPUSD_WITH_INSTABILITY_WARNING"
WIDEN, FALLBACK = "WIDEN_CONTEXT", "CONSIDER_EURUSD_FALLBACK"


def widened(p: Params, which: str) -> Params:
    """The one widening that may follow a gate: of the percentile or of the break buffer."""
    if which == "range_pct_max":
        return replace(p, range_pct_max=0.40)
    if which == "break_buffer_atr":
        return replace(p, break_buffer_atr=0.05)
    raise ValueError(f"can't widen {which!r}: range_pct_max or break_buffer_atr")


# Fixed value: the holdout's first instant, 2023-01-01 UTC.
HOLDOUT_NS = 1_672_531_200_000_000_000


class VaultError(ValueError):
    """A range that reaches into the holdout."""


def guard_holdout(end_ns: int) -> None:
    """Refuses ranges that end after the holdout begins; an end at its first instant is outside, since ends are exclusive."""
    if end_ns > HOLDOUT_NS:
        raise VaultError("the range reaches into the holdout, which begins on 2023-01-01")

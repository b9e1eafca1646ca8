"""The data-quality battery. Every check gives samples, a row for each bad tick, bar, day or bucket, and findings count them.

A sample is (instrument, check_id, check_name, severity, year, ts_utc_ns, detail, sample). Findings (FINDINGS) are one aggregation of the samples, which are
stored whole beside them: what a report shows of them is cut there. All checks of ticks are flags over one window by month batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators.features import with_day
from tidemark.operators.sessions import day_spine

FINDINGS = "instrument string, check_id string, check_name string, severity string, year int, count long, detail string"
ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"


def _iso(ns: str) -> Column:
    return F.expr(f"date_format({T.instant(ns)}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")")


# The checks, with their names and severities.
CHECKS = {
    "E-01": ("negative spread", ERROR), "E-02": ("non-positive price", ERROR), "E-03": ("timestamp reversal", ERROR), "E-04": ("missing hours above threshold", ERROR), "E-05": ("malformed blob", ERROR), "E-06": ("log and store disagree", ERROR),
    "W-01": ("duplicate tick", WARNING), "W-02": ("price jump", WARNING), "W-03": ("weekend activity", WARNING), "W-04": ("extreme spread", WARNING), "W-05": ("thin day", WARNING), "W-06": ("missing hours below threshold", WARNING), "W-07": ("zero spread", WARNING),
    "I-01": ("clock-change days", INFO), "I-02": ("no volume", INFO), "I-03": ("skipped buckets", INFO), "I-04": ("days without baseline", INFO),
}


def _of_check(check: Column, part: int) -> Column:
    """The name (0) or severity (1) of a check."""
    return F.create_map(*(F.lit(x) for k, v in CHECKS.items() for x in (k, v[part])))[check]


def _sampled(rows: DataFrame, check: Column, detail: Column, sample: Column | None = None, ts: str = "ts_utc_ns", yearly: bool = True) -> DataFrame:
    year = F.expr(T.utc_year(ts)) if yearly else F.lit(None).cast("int")
    return rows.select("instrument", check.alias("check_id"), _of_check(check, 0).alias("check_name"), _of_check(check, 1).alias("severity"), year.alias("year"), F.col(ts).alias("ts_utc_ns"), detail.alias("detail"), (sample if sample is not None else _iso(ts)).alias("sample"))


def findings(samples: DataFrame) -> DataFrame:
    """FINDINGS: how many samples each check has by instrument and year (null for checks that go by no year)."""
    return samples.groupBy("instrument", "check_id", "check_name", "severity", "year").agg(F.count("sample").alias("count"), F.first("detail").alias("detail")).select([f.split()[0] for f in FINDINGS.split(", ")])


def first_samples(samples: DataFrame, few: int) -> DataFrame:
    """(instrument, check_id, year, sample array): the first few samples of each finding, for a report."""
    w = W.partitionBy("instrument", "check_id", "year").orderBy("ts_utc_ns", "sample")
    kept = samples.where("sample is not null").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= few)
    return kept.groupBy("instrument", "check_id", "year").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "sample"))), lambda x: x["sample"]).alias("sample"))


def negative_spread(ticks: DataFrame) -> DataFrame:
    return ticks.where("ask - bid < 0")


def zero_spread(ticks: DataFrame) -> DataFrame:
    return ticks.where("ask - bid = 0")


def non_positive_price(ticks: DataFrame) -> DataFrame:
    return ticks.where("bid <= 0 or ask <= 0")


def _file_order(ticks: DataFrame) -> object:
    month = [F.expr(T.month_key("ts_utc_ns")).alias("_m")] if "month" not in ticks.columns else ["year", "month"]
    return W.partitionBy("instrument", *month).orderBy("row_sequence")


def reversals(ticks: DataFrame) -> DataFrame:
    """Rows earlier than the one before them in file order, within a month's batch."""
    return ticks.withColumn("_p", F.lag("ts_utc_ns").over(_file_order(ticks))).where("ts_utc_ns < _p").drop("_p")


def duplicates(ticks: DataFrame) -> DataFrame:
    """Rows equal to the one before them in time, bid and ask."""
    return ticks.withColumn("_p", F.lag(F.struct("ts_utc_ns", "bid", "ask")).over(_file_order(ticks))).where("_p = struct(ts_utc_ns, bid, ask)").drop("_p")


def trailing_sd(value: str, w: object, reach: int) -> Column:
    """Population deviation of the reach values before a row, null until there are as many. From running sums, so that it costs the same for any reach."""
    end = lambda f, k: F.lag(f.over(w.rowsBetween(W.unboundedPreceding, 0)), k).over(w)
    x = F.col(value)
    parts = [F.coalesce(end(f, 1), F.lit(0)) - F.coalesce(end(f, reach + 1), F.lit(0)) for f in (F.count(x), F.sum(x), F.sum(x * x))]
    n, total, squares = parts
    return F.when(n == reach, F.sqrt(F.greatest(squares / reach - (total / reach) * (total / reach), F.lit(0.0))))


def _moves(ticks: DataFrame, reach: int) -> DataFrame:
    """Adds move, of the mid in file order within a month's batch, and the deviation of the reach moves before it."""
    w = _file_order(ticks)
    moved = ticks.withColumn("_mid", (F.col("bid") + F.col("ask")) / 2).withColumn("move", F.col("_mid") - F.lag("_mid").over(w))
    return moved.withColumn("_sd", trailing_sd("move", w, reach)).drop("_mid")


def jumps(ticks: DataFrame, reach: int = 1000, times: float = 10.0) -> DataFrame:
    """Moves of the mid larger than so many standard deviations of the reach moves before it, within a month's batch."""
    return _moves(ticks, reach).where(F.abs("move") > times * F.col("_sd")).drop("_sd")


def weekend_activity(ticks: DataFrame, margin_ns: int = 5 * T.MINUTE) -> DataFrame:
    """Ticks in the weekend gap, and still so at a margin before and after."""
    return ticks.where(" and ".join(T.weekend_gap(f"(ts_utc_ns + {d})") for d in (0, margin_ns, -margin_ns)))


def zero_volume_batches(ticks: DataFrame) -> DataFrame:
    """(instrument, month) of batches without any volume."""
    none = F.bool_and((F.coalesce("bid_volume", F.lit(0.0)) == 0) & (F.coalesce("ask_volume", F.lit(0.0)) == 0))
    return ticks.groupBy("instrument", F.expr(T.month_key("ts_utc_ns")).alias("month_key")).agg(none.alias("_none"), F.min("ts_utc_ns").alias("ts_utc_ns")).where("_none").drop("_none")


def spread_buckets(bars: DataFrame) -> DataFrame:
    """Bars with the trading day's weekday (1: Monday) and the London hour."""
    return with_day(bars).withColumn("weekday", F.expr("weekday(day) + 1")).withColumn("hour", F.expr(T.local_hour("ts_utc_ns")))


def bucket_medians(bars: DataFrame) -> DataFrame:
    return spread_buckets(bars).groupBy("instrument", "weekday", "hour").agg(F.percentile("spread_twa", F.lit(0.5)).alias("median_spread"), F.count(F.lit(1)).alias("n"))


def extreme_spreads(bars: DataFrame, times: float = 20.0, least: int = 100) -> DataFrame:
    """Bars whose spread exceeds so many medians of their weekday and hour, in buckets of at least so many bars."""
    stats = bucket_medians(bars).where(F.col("n") >= least)
    # at most 168 rows for each instrument: Spark broadcasts it where it measures it as small
    return spread_buckets(bars).join(stats, ["instrument", "weekday", "hour"]).where(F.col("spread_twa") > times * F.col("median_spread"))


def skipped_buckets(bars: DataFrame, least: int = 100) -> DataFrame:
    return bucket_medians(bars).where(F.col("n") < least)


def bars_per_day(bars: DataFrame) -> DataFrame:
    """(instrument, day, n_bars, start_ns, end_ns, contained) for every calendar day from first to last; contained: not cut off by the data's ends."""
    counts = with_day(bars).groupBy("instrument", "day").agg(F.count(F.lit(1)).alias("n_bars"))
    span = bars.groupBy("instrument").agg(F.min("ts_utc_ns").alias("_lo"), (F.max("ts_utc_ns") + T.MINUTE).alias("_hi"))
    days = day_spine(bars).join(counts, ["instrument", "day"], "left").join(span, "instrument").withColumn("n_bars", F.coalesce("n_bars", F.lit(0)))
    days = days.withColumn("start_ns", F.expr(T.day_start("day"))).withColumn("end_ns", F.expr(T.day_end("day")))
    return days.withColumn("contained", F.expr("start_ns >= _lo and end_ns <= _hi")).drop("_lo", "_hi")


def weekday_counts(bars: DataFrame, reach: int = 20) -> DataFrame:
    """Contained weekdays with the median count of the reach weekdays before; null for the first ones."""
    days = bars_per_day(bars).where("contained and weekday(day) < 5")
    w = W.partitionBy("instrument").orderBy("day")
    before = w.rowsBetween(-reach, -1)
    return days.withColumn("baseline", F.when(F.count("n_bars").over(before) == reach, F.percentile("n_bars", F.lit(0.5)).over(before)))


def thin_days(bars: DataFrame, threshold: float = 0.60, reach: int = 20) -> DataFrame:
    return weekday_counts(bars, reach).where(F.col("n_bars") < threshold * F.col("baseline"))


def unmeasured_days(bars: DataFrame, reach: int = 20) -> DataFrame:
    return weekday_counts(bars, reach).where("baseline is null")


def clock_change_days(bars: DataFrame) -> DataFrame:
    """Contained trading days of another length than 24 hours, with their bars: these lie in the weekend and must have none."""
    return bars_per_day(bars).where(f"contained and end_ns - start_ns <> {T.DAY}")


def tick_samples(ticks: DataFrame, reach: int = 1000, times: float = 10.0, margin_ns: int = 5 * T.MINUTE) -> DataFrame:
    """Samples of all checks of ticks: one window by month batch for all of them, and one aggregation for the volumes."""
    rows = _moves(ticks, reach).withColumn("_p", F.lag(F.struct("ts_utc_ns", "bid", "ask")).over(_file_order(ticks)))
    gap = " and ".join(T.weekend_gap(f"(ts_utc_ns + {d})") for d in (0, margin_ns, -margin_ns))
    flags = {
        "E-01": (F.col("ask") - F.col("bid") < 0, "ask below bid"), "E-02": (F.expr("bid <= 0 or ask <= 0"), "bid or ask not above 0"), "E-03": (F.col("ts_utc_ns") < F.col("_p.ts_utc_ns"), "earlier than the row before"),
        "W-01": (F.col("_p") == F.struct("ts_utc_ns", "bid", "ask"), "equal to the row before"), "W-02": (F.abs("move") > times * F.col("_sd"), f"mid moved more than {times:g} standard deviations of the {reach} moves before"),
        "W-03": (F.expr(gap), "inside the weekend gap by 5 minutes at least"), "W-07": (F.col("ask") == F.col("bid"), "ask equals bid"),
    }
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(k).alias("check"), F.lit(detail).alias("detail"))) for k, (test, detail) in flags.items())))
    each = rows.withColumn("_f", F.explode(found))
    silent = _sampled(zero_volume_batches(ticks), F.lit("I-02"), F.lit("months without any volume"), F.col("month_key"))
    return _sampled(each, F.col("_f.check"), F.col("_f.detail")).unionByName(silent)


def bar_samples(bars: DataFrame, least: int = 100, threshold: float = 0.60, reach: int = 20, times: float = 20.0) -> DataFrame:
    """Samples of all checks of bars. I-01 has a row without a sample for each instrument, so that it is found with a count of 0 too."""
    at_day = lambda df: df.withColumn("ts_utc_ns", F.col("end_ns") - 1)
    day = F.col("day").cast("string")
    bucket = F.format_string("weekday %d hour %02d: %d bars", "weekday", "hour", "n")
    none = F.lit(None).cast("long")
    changes = clock_change_days(bars)
    leaks = at_day(changes.where("n_bars > 0").unionByName(bars.select("instrument").distinct(), allowMissingColumns=True))
    parts = [
        _sampled(extreme_spreads(bars, times, least), F.lit("W-04"), F.lit(f"more than {times:g} medians of the weekday and hour")),
        _sampled(at_day(thin_days(bars, threshold, reach)), F.lit("W-05"), F.lit(f"fewer bars than {threshold:g} of the median of the {reach} weekdays before"), day),
        _sampled(at_day(unmeasured_days(bars, reach)), F.lit("I-04"), F.lit(f"the first {reach} weekdays"), day),
        _sampled(leaks, F.lit("I-01"), F.lit("trading days not of 24 hours, which must have no bars"), day, yearly=False),
        _sampled(skipped_buckets(bars, least).withColumn("ts_utc_ns", none), F.lit("I-03"), F.lit(f"buckets of fewer than {least} bars"), bucket, yearly=False),
    ]
    return reduce(DataFrame.unionByName, parts)


def check_samples(ticks: DataFrame, bars: DataFrame, least: int = 100, threshold: float = 0.60, reach: int = 20, jump_reach: int = 1000) -> DataFrame:
    """All samples of all checks of ticks and bars."""
    return tick_samples(ticks, jump_reach).unionByName(bar_samples(bars, least, threshold, reach))


def ordered(found: DataFrame) -> DataFrame:
    """Findings by severity, check and year."""
    rank = F.when(F.col("severity") == ERROR, 0).when(F.col("severity") == WARNING, 1).otherwise(2)
    return found.orderBy(rank, "check_id", "instrument", F.col("year").asc_nulls_first())


def run_checks(ticks: DataFrame, bars: DataFrame, least: int = 100, threshold: float = 0.60, reach: int = 20, jump_reach: int = 1000) -> DataFrame:
    """All findings, ordered by severity, check and year."""
    return ordered(findings(check_samples(ticks, bars, least, threshold, reach, jump_reach)))


def severities(found: DataFrame) -> DataFrame:
    """(severity, n): findings that count anything."""
    return found.where("count > 0").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def sealable(found: DataFrame) -> bool:
    return not found.where((F.col("severity") == ERROR) & (F.col("count") > 0)).limit(1).count()


def missing_hours(hours: DataFrame, blobs: DataFrame, most: float = 0.005) -> DataFrame:
    """(year, n_expected, n_missing, check_id): hours (hour_ns) outside the weekend without a blob; E-04 beyond a share, W-06 below, no row for none."""
    open_hours = hours.where(f"not {T.weekend_gap('hour_ns')}").withColumn("year", F.expr(T.utc_year("hour_ns")))
    lost = open_hours.join(blobs.select("hour_ns"), "hour_ns", "left_anti").groupBy("year").agg(F.count(F.lit(1)).alias("n_missing"))
    n = open_hours.groupBy("year").agg(F.count(F.lit(1)).alias("n_expected"))
    return n.join(lost, "year").withColumn("check_id", F.when(F.col("n_missing") / F.col("n_expected") > most, "E-04").otherwise("W-06"))


def log_disagreements(log: DataFrame, blobs: DataFrame) -> DataFrame:
    """(hour_ns, reason): E-06, hours that the log has fetched and the store lacks, or the other way round. log: (hour_ns, status)."""
    both = log.select("hour_ns", "status").join(blobs.select("hour_ns", F.lit(True).alias("there")), "hour_ns", "full_outer")
    reason = F.when(F.col("status").isin("fetched", "empty") & F.col("there").isNull(), "logged but not stored").when(F.col("there") & (F.col("status").isNull() | ~F.col("status").isin("fetched", "empty", "skipped_existing")), "stored but not logged")
    return both.withColumn("reason", reason).where("reason is not null").select("hour_ns", "reason")


def store_samples(hours: DataFrame, blobs: DataFrame, log: DataFrame, read: DataFrame, instrument: str, most: float = 0.005) -> DataFrame:
    """Samples of the checks of stored hours: missing ones (E-04 or W-06), malformed blobs (E-05) and disagreements of log and store (E-06). read: what
    ingest.hour_ticks made of the blobs."""
    lost = missing_hours(hours, blobs, most).select("year", "check_id")
    gone = hours.where(f"not {T.weekend_gap('hour_ns')}").join(blobs.select("hour_ns"), "hour_ns", "left_anti").withColumn("year", F.expr(T.utc_year("hour_ns"))).join(lost, "year")
    named = lambda df: df.withColumn("instrument", F.lit(instrument))
    off = log_disagreements(log, blobs)
    return reduce(DataFrame.unionByName, [
        _sampled(named(gone), F.col("check_id"), F.lit(f"hours outside the weekend without a blob, against a threshold of {most:g}"), ts="hour_ns"),
        malformed_samples(read),
        _sampled(named(off), F.lit("E-06"), F.col("reason"), F.concat(_iso("hour_ns"), F.lit(" "), F.col("reason")), ts="hour_ns", yearly=False).withColumn("detail", F.lit("the log and the store disagree")),
    ])


def malformed_samples(read: DataFrame) -> DataFrame:
    """E-05: the rows with an error of what ingest.hour_ticks made of blobs."""
    return _sampled(read.where("error is not null"), F.lit("E-05"), F.lit("blobs that can't be read: no LZMA stream, or no whole number of records"), F.col("error"), yearly=False)

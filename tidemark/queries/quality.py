"""The data-quality battery, one query for each check. The driver's ticks are clean, so each tick check runs on ticks with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators import quality as Q
from tidemark.queries.base import BARS, TICKS, WINDOWS, bars, day_of, local, rounded, table, ticks, weekend

# The rules' own numbers: a jump is 10 deviations of 1000 moves, a bucket has 100 bars, a day is thin below 0.6 of 20 weekdays.
REACH, TIMES, LEAST, THIN_REACH, THIN = 1000, 10.0, 100, 20, 0.6


def faulty(spark, sf) -> DataFrame:
    """Every 997th tick is half an hour early, every 499th has ask below bid, every 211th repeats the one before it in its instrument, and every 1501st is far off."""
    t = ticks(spark, sf)
    w = Q.W.partitionBy("instrument").orderBy("row_sequence")
    again = F.col("row_sequence") % 211 == 0
    t = t.select(*t.columns, *(F.lag(c).over(w).alias(f"_{c}") for c in ("ts_utc_ns", "bid", "ask")))
    t = t.withColumns({c: F.when(again, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in ("ts_utc_ns", "bid", "ask")}).drop("_ts_utc_ns", "_bid", "_ask")
    off = F.when(F.col("row_sequence") % 1501 == 0, 0.5).otherwise(0.0)
    t = t.withColumns({"bid": F.round(F.col("bid") + off, 6), "ask": F.round(F.col("ask") + off, 6)})
    t = t.withColumn("ts_utc_ns", F.when(F.col("row_sequence") % 997 == 0, F.col("ts_utc_ns") - 30 * T.MINUTE).otherwise(F.col("ts_utc_ns")))
    return t.withColumn("ask", F.when(F.col("row_sequence") % 499 == 0, F.round(F.col("bid") - 0.0001, 6)).otherwise(F.col("ask")))


def wide_bars(spark, sf) -> DataFrame:
    """Bars of years, for rules that look back over weeks or at many bars: lineitem's ship dates with a time of day from its keys; the spread is 2 to 10, and 40 times that in some."""
    second = F.expr("(l_orderkey * 7919 + l_linenumber * 104729) % 86400")
    spread = (F.col("l_tax") * 100 + 2) * F.when(F.col("l_orderkey") % 499 == 0, 40.0).otherwise(1.0)
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("instrument"), (F.expr("unix_micros(cast(l_shipdate as timestamp)) * 1000") + second * 1_000_000_000).alias("ts_utc_ns"), F.round(spread, 6).alias("spread_twa"))


def thinned(spark, sf) -> DataFrame:
    """The same bars without most of those of every 97th day."""
    return wide_bars(spark, sf).where("not (ts_utc_ns div 86400000000000 % 97 = 0 and ts_utc_ns div 1000000000 % 3600 >= 1200)")


def _keys(df):
    return df.select("instrument", "row_sequence")


def e01(spark, sf):
    return _keys(Q.negative_spread(faulty(spark, sf)))


def e02(spark, sf):
    return _keys(Q.non_positive_price(ticks(spark, sf).withColumn("bid", F.col("value"))))


def e03(spark, sf):
    return _keys(Q.reversals(faulty(spark, sf)))


def w01(spark, sf):
    return _keys(Q.duplicates(faulty(spark, sf)))


def w02(spark, sf):
    return rounded(Q.jumps(faulty(spark, sf)).select("instrument", "row_sequence", "move"), 6)


def w03(spark, sf):
    return _keys(Q.weekend_activity(ticks(spark, sf)))


def w07(spark, sf):
    return _keys(Q.zero_spread(ticks(spark, sf)))


def i02(spark, sf):
    return Q.zero_volume_batches(ticks(spark, sf)).select("instrument", "month_key")


def op62(spark, sf):
    d = Q.bars_per_day(bars(spark, sf))
    return d.select("instrument", F.col("day").cast("string").alias("day"), "n_bars", F.col("contained").cast("long").alias("contained"))


def op63(spark, sf):
    return rounded(Q.bucket_medians(bars(spark, sf)))


def w04(spark, sf):
    return Q.extreme_spreads(wide_bars(spark, sf)).select("instrument", "ts_utc_ns", "spread_twa")


def i03(spark, sf):
    return rounded(Q.skipped_buckets(bars(spark, sf)).select("instrument", "weekday", "hour", "n"))


def op90(spark, sf):
    return rounded(Q.weekday_counts(thinned(spark, sf)).select("instrument", F.col("day").cast("string").alias("day"), "n_bars", "baseline"))


def w05(spark, sf):
    return rounded(Q.thin_days(thinned(spark, sf)).select("instrument", F.col("day").cast("string").alias("day"), "n_bars"))


def i04(spark, sf):
    return Q.unmeasured_days(thinned(spark, sf)).select("instrument", F.col("day").cast("string").alias("day"))


def i01(spark, sf):
    """On dates with clock changes: orders stand in for bars, by the second's time of day that their key gives."""
    o = table(spark, sf, "orders").select(F.lit("o").alias("instrument"), (F.expr("unix_micros(cast(o_orderdate as timestamp)) * 1000") + F.col("o_orderkey") % 86400 * 1_000_000_000).alias("ts_utc_ns"))
    return Q.clock_change_days(o).select("instrument", F.col("day").cast("string").alias("day"), "n_bars", ((F.col("end_ns") - F.col("start_ns")) / T.HOUR).cast("long").alias("hours"))


def op75(spark, sf):
    found = Q.run_checks(faulty(spark, sf), bars(spark, sf))
    return found.groupBy("check_id", "severity").agg(F.sum("count").cast("long").alias("n"))


def op89(spark, sf):
    w = Q.W.partitionBy("instrument").orderBy("row_sequence")
    t = ticks(spark, sf).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    return rounded(t.select("instrument", "row_sequence", Q.trailing_sd("mid", w, REACH).alias("sd")), 5)


def op114(spark, sf):
    """Hours with no event at all stand for hours without a blob."""
    e = table(spark, sf, "events").select((F.expr("unix_micros(cast(ts as timestamp)) div 3600000000") * T.HOUR).alias("hour_ns"), "event_type")
    span = e.agg(F.min("hour_ns").alias("lo"), F.max("hour_ns").alias("hi"))
    hours = span.select(F.explode(F.sequence("lo", "hi", F.lit(T.HOUR))).alias("hour_ns"))
    return rounded(Q.missing_hours(hours, e.where("event_type = 'click'").select("hour_ns").distinct()))


def op116(spark, sf):
    e = table(spark, sf, "events").select((F.expr("unix_micros(cast(ts as timestamp)) div 3600000000") * T.HOUR).alias("hour_ns"), "event_type")
    log = e.where("event_type = 'view'").select("hour_ns", F.lit("fetched").alias("status")).distinct()
    return Q.log_disagreements(log, e.where("event_type = 'click'").select("hour_ns").distinct())


QUERIES = {
    "OP106_negative_spread": e01, "OP107_zero_spread": w07, "OP108_non_positive_price": e02, "OP109_reversal": e03, "OP110_duplicate": w01, "OP111_jump": w02, "OP112_weekend_activity": w03, "OP113_zero_volume": i02,
    "OP114_missing_hours": op114, "OP116_log_disagreement": op116, "OP117_extreme_spread": w04, "OP118_skipped_buckets": i03, "OP119_thin_day": w05, "OP120_no_baseline": i04, "OP121_clock_change_days": i01,
    "OP62_bars_per_day": op62, "OP63_bucket_median": op63, "OP75_findings_by_check": op75, "OP89_trailing_stdev": op89, "OP90_trailing_median": op90,
}

FAULTY = TICKS + """, again AS (
  SELECT instrument, row_sequence, CASE WHEN row_sequence % 211 = 0 THEN coalesce(lag(ts_utc_ns) OVER o, ts_utc_ns) ELSE ts_utc_ns END AS ts0,
         CASE WHEN row_sequence % 211 = 0 THEN coalesce(lag(bid) OVER o, bid) ELSE bid END AS bid, CASE WHEN row_sequence % 211 = 0 THEN coalesce(lag(ask) OVER o, ask) ELSE ask END AS ask0
  FROM ticks WINDOW o AS (PARTITION BY instrument ORDER BY row_sequence)), again0 AS (
  SELECT * REPLACE (round(bid + CASE WHEN row_sequence % 1501 = 0 THEN 0.5 ELSE 0 END, 6) AS bid, round(ask0 + CASE WHEN row_sequence % 1501 = 0 THEN 0.5 ELSE 0 END, 6) AS ask0) FROM again), shifted AS (
  SELECT instrument, row_sequence, bid, CASE WHEN row_sequence % 997 = 0 THEN ts0 - 1800000000000 ELSE ts0 END AS ts_utc_ns, CASE WHEN row_sequence % 499 = 0 THEN round(bid - 0.0001, 6) ELSE ask0 END AS ask
  FROM again0), faulty AS (
  SELECT *, (bid + ask) / 2 AS mid, strftime(make_timestamp(ts_utc_ns // 1000), '%Y-%m') AS m FROM shifted)"""
_DAYS = f"""counts AS (SELECT instrument, {day_of('ts_utc_ns')} AS day, count(*) AS n FROM bars GROUP BY ALL), span AS (SELECT instrument, min(ts_utc_ns) AS lo, max(ts_utc_ns) + 60000000000 AS hi FROM bars GROUP BY ALL),
  per_day AS (SELECT s.instrument, s.day, coalesce(c.n, 0) AS n_bars, epoch_us(timezone('America/New_York', CAST(s.day AS TIMESTAMP) - INTERVAL 7 HOUR)) * 1000 >= p.lo AND epoch_us(timezone('America/New_York', CAST(s.day AS TIMESTAMP) + INTERVAL 17 HOUR)) * 1000 <= p.hi AS contained
    FROM spine s LEFT JOIN counts c USING (instrument, day) JOIN span p USING (instrument)),
  weekdays AS (SELECT *, CASE WHEN count(*) OVER w = {THIN_REACH} THEN quantile_cont(n_bars, 0.5) OVER w END AS baseline FROM per_day WHERE contained AND isodow(day) <= 5 WINDOW w AS (PARTITION BY instrument ORDER BY day ROWS BETWEEN {THIN_REACH} PRECEDING AND 1 PRECEDING))"""
_BUCKET = f"""bucketed AS (SELECT *, isodow({day_of('ts_utc_ns')}) AS weekday, hour({local('ts_utc_ns', 'Europe/London')}) AS hour FROM bars), medians AS (
  SELECT instrument, weekday, hour, quantile_cont(spread_twa, 0.5) AS median_spread, count(*) AS n FROM bucketed GROUP BY ALL)"""
_WIDE = """wide AS (SELECT l_returnflag AS instrument, epoch_us(l_shipdate) * 1000 + (l_orderkey * 7919 + l_linenumber * 104729) % 86400 * 1000000000 AS ts_utc_ns, round((l_tax * 100 + 2) * CASE WHEN l_orderkey % 499 = 0 THEN 40.0 ELSE 1.0 END, 6) AS spread_twa FROM lineitem)"""
_THIN = _WIDE + ", bars AS (SELECT * FROM wide WHERE NOT (ts_utc_ns // 86400000000000 % 97 = 0 AND ts_utc_ns // 1000000000 % 3600 >= 1200)), " + WINDOWS.split(", windows0", 1)[0]
_WIDE_BUCKET = _WIDE + ", bars AS (SELECT * FROM wide), " + _BUCKET
_HOURS = "hours AS (SELECT DISTINCT epoch_us(ts) // 3600000000 * 3600000000000 AS hour_ns, event_type FROM events)"
_MOVES = f"""moves AS (SELECT *, mid - lag(mid) OVER (PARTITION BY instrument, m ORDER BY row_sequence) AS move FROM faulty), sds AS (
  SELECT *, CASE WHEN count(move) OVER w = {REACH} THEN stddev_pop(move) OVER w END AS sd FROM moves WINDOW w AS (PARTITION BY instrument, m ORDER BY row_sequence ROWS BETWEEN {REACH} PRECEDING AND 1 PRECEDING))"""
_WEEKEND = " AND ".join(weekend(f"(ts_utc_ns + {d})") for d in (0, 5 * T.MINUTE, -5 * T.MINUTE))
_REVERSED = "SELECT instrument, row_sequence FROM (SELECT *, lag(ts_utc_ns) OVER (PARTITION BY instrument, m ORDER BY row_sequence) AS p FROM faulty) WHERE ts_utc_ns < p"
_REPEATED = "SELECT instrument, row_sequence FROM (SELECT *, lag(ts_utc_ns) OVER o AS p, lag(bid) OVER o AS b, lag(ask) OVER o AS a FROM faulty WINDOW o AS (PARTITION BY instrument, m ORDER BY row_sequence)) WHERE ts_utc_ns = p AND bid = b AND ask = a"
ORACLE_SQL = {
    "OP106_negative_spread": f"WITH {FAULTY} SELECT instrument, row_sequence FROM faulty WHERE ask < bid",
    "OP107_zero_spread": f"WITH {TICKS} SELECT instrument, row_sequence FROM ticks WHERE ask = bid",
    "OP108_non_positive_price": f"WITH {TICKS} SELECT instrument, row_sequence FROM ticks WHERE value <= 0 OR ask <= 0",
    "OP109_reversal": f"WITH {FAULTY} {_REVERSED}",
    "OP110_duplicate": f"WITH {FAULTY} {_REPEATED}",
    "OP111_jump": f"WITH {FAULTY}, {_MOVES} SELECT instrument, row_sequence, round(move, 6) + 0.0 AS move FROM sds WHERE abs(move) > {TIMES} * sd",
    "OP112_weekend_activity": f"WITH {TICKS} SELECT instrument, row_sequence FROM ticks WHERE {_WEEKEND}",
    "OP113_zero_volume": f"WITH {TICKS} SELECT DISTINCT instrument, strftime(make_timestamp(ts_utc_ns // 1000), '%Y-%m') AS month_key FROM ticks",
    "OP114_missing_hours": f"""WITH {_HOURS}, every AS (SELECT unnest(generate_series(min(hour_ns), max(hour_ns), 3600000000000)) AS hour_ns FROM hours), open_hours AS (SELECT hour_ns, year(make_timestamp(hour_ns // 1000)) AS year FROM every WHERE NOT {weekend('hour_ns')}), joined AS (
      SELECT o.year, count(*) AS n_expected, count(*) FILTER (h.hour_ns IS NULL) AS n_missing FROM open_hours o LEFT JOIN (SELECT hour_ns FROM hours WHERE event_type = 'click') h USING (hour_ns) GROUP BY o.year)
      SELECT year, n_expected, n_missing, CASE WHEN n_missing / n_expected > 0.005 THEN 'E-04' ELSE 'W-06' END AS check_id FROM joined WHERE n_missing > 0""",
    "OP116_log_disagreement": f"WITH {_HOURS}, v AS (SELECT hour_ns FROM hours WHERE event_type = 'view'), c AS (SELECT hour_ns FROM hours WHERE event_type = 'click') SELECT hour_ns, 'logged but not stored' AS reason FROM (FROM v EXCEPT FROM c) UNION ALL SELECT hour_ns, 'stored but not logged' FROM (FROM c EXCEPT FROM v)",
    "OP117_extreme_spread": f"WITH {_WIDE_BUCKET} SELECT instrument, ts_utc_ns, spread_twa FROM bucketed JOIN medians USING (instrument, weekday, hour) WHERE n >= {LEAST} AND spread_twa > 20.0 * median_spread",
    "OP118_skipped_buckets": f"WITH {BARS}, {_BUCKET} SELECT instrument, weekday, hour, n FROM medians WHERE n < {LEAST}",
    "OP119_thin_day": f"WITH {_THIN}, {_DAYS} SELECT instrument, CAST(day AS VARCHAR) AS day, n_bars FROM weekdays WHERE n_bars < {THIN} * baseline",
    "OP120_no_baseline": f"WITH {_THIN}, {_DAYS} SELECT instrument, CAST(day AS VARCHAR) AS day FROM weekdays WHERE baseline IS NULL",
    "OP121_clock_change_days": f"""WITH bars AS (SELECT 'o' AS instrument, epoch_us(o_orderdate) * 1000 + o_orderkey % 86400 * 1000000000 AS ts_utc_ns FROM orders), spine AS (SELECT CAST(unnest(generate_series(min({day_of('ts_utc_ns')}), max({day_of('ts_utc_ns')}), INTERVAL 1 DAY)) AS DATE) AS day FROM bars),
      edges AS (SELECT day, epoch_us(timezone('America/New_York', CAST(day AS TIMESTAMP) - INTERVAL 7 HOUR)) * 1000 AS s, epoch_us(timezone('America/New_York', CAST(day AS TIMESTAMP) + INTERVAL 17 HOUR)) * 1000 AS e FROM spine), counts AS (SELECT {day_of('ts_utc_ns')} AS day, count(*) AS n FROM bars GROUP BY ALL)
      SELECT 'o' AS instrument, CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS n_bars, (e - s) // 3600000000000 AS hours FROM edges LEFT JOIN counts USING (day) WHERE e - s <> 86400000000000 AND s >= (SELECT min(ts_utc_ns) FROM bars) AND e <= (SELECT max(ts_utc_ns) + 60000000000 FROM bars)""",
    "OP62_bars_per_day": f"WITH {BARS}, {WINDOWS}, {_DAYS} SELECT instrument, CAST(day AS VARCHAR) AS day, n_bars, CAST(contained AS BIGINT) AS contained FROM per_day",
    "OP63_bucket_median": f"WITH {BARS}, {_BUCKET} SELECT instrument, weekday, hour, round(median_spread, 8) AS median_spread, n FROM medians",
    "OP75_findings_by_check": f"""WITH {FAULTY}, {_MOVES}, every AS (SELECT 'E-01' AS check_id, 'ERROR' AS severity, count(*) AS n FROM faulty WHERE ask < bid
      UNION ALL SELECT 'E-03', 'ERROR', count(*) FROM ({_REVERSED}) UNION ALL SELECT 'W-01', 'WARNING', count(*) FROM ({_REPEATED}) UNION ALL SELECT 'W-02', 'WARNING', count(*) FROM sds WHERE abs(move) > 10 * sd HAVING count(*) > 0
      UNION ALL SELECT 'W-03', 'WARNING', count(*) FROM faulty WHERE {_WEEKEND} UNION ALL SELECT 'W-07', 'WARNING', count(*) FROM faulty WHERE ask = bid UNION ALL SELECT 'I-02', 'INFO', count(DISTINCT (instrument, m)) FROM faulty
      UNION ALL SELECT * FROM (WITH {BARS.split('ticks AS', 1)[0]}{BARS}, {WINDOWS}, {_DAYS}, {_BUCKET} SELECT 'W-05', 'WARNING', count(*) FROM weekdays WHERE n_bars < {THIN} * baseline HAVING count(*) > 0 UNION ALL SELECT 'I-04', 'INFO', count(*) FROM weekdays WHERE baseline IS NULL
      UNION ALL SELECT 'I-03', 'INFO', count(*) FROM medians WHERE n < {LEAST} HAVING count(*) > 0 UNION ALL SELECT 'I-01', 'INFO', 0 UNION ALL SELECT 'W-04', 'WARNING', count(*) FROM bucketed JOIN medians USING (instrument, weekday, hour) WHERE n >= {LEAST} AND spread_twa > 20.0 * median_spread HAVING count(*) > 0)) SELECT * FROM every WHERE n > 0 OR check_id = 'I-01'""",
    "OP89_trailing_stdev": f"WITH {TICKS} SELECT instrument, row_sequence, round(CASE WHEN count(*) OVER w = {REACH} THEN stddev_pop((bid + ask) / 2) OVER w END, 5) AS sd FROM ticks WINDOW w AS (PARTITION BY instrument ORDER BY row_sequence ROWS BETWEEN {REACH} PRECEDING AND 1 PRECEDING)",
    "OP90_trailing_median": f"WITH {_THIN}, {_DAYS} SELECT instrument, CAST(day AS VARCHAR) AS day, n_bars, round(baseline, 8) AS baseline FROM weekdays",
}

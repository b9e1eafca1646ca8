"""Ticks from the driver's table events, the same way in Spark and in SQL; shared parts of the SQL twins.

instrument: event_type. bid: 1 + value / 10000 to six decimals. ask: bid plus (k mod 7) hundredths of a thousandth, k from props. row_sequence: event_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators.bars import resample, with_gaps
from tidemark.sources import ticks as S
from tidemark.sources.scratch import place


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    T.check_utc(spark)
    k = F.get_json_object("props", "$.k").cast("long")
    bid = F.round(1 + F.col("value") / 10000, 6)
    none = F.lit(None).cast("double")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("instrument"), F.expr("unix_micros(cast(ts as timestamp)) * 1000").alias("ts_utc_ns"), bid.alias("bid"), F.round(bid + (k % 7) * 0.00001, 6).alias("ask"),
        none.alias("bid_volume"), none.alias("ask_volume"), F.col("event_id").alias("row_sequence"), "value")


_stored: dict[tuple, str] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """The files of a table: names, lengths and times. A table that is written anew has another."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, found = at.getFileSystem(spark._jsc.hadoopConfiguration()), []
    files = fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """The bars of all ticks, from a table that the first query of a session that needs them writes, as the engine stores them; anew when the ticks' files are others.
    With tidemark.bars.stored set to false each query makes its own."""
    if spark.conf.get("tidemark.bars.stored", "true") == "false":
        return with_gaps(resample(ticks(spark, sf)))
    key = (spark.sparkContext.applicationId, sf, _state(spark, f"{sf}/events.parquet"))
    at = spark._jvm.org.apache.hadoop.fs.Path(_stored.get(key, "/nowhere"))
    if key not in _stored or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        root = place(spark, "bars")
        S.write_bars(with_gaps(resample(ticks(spark, sf))), root)
        _stored[key] = root
    return S.scan(spark, _stored[key], S.BARS)


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


NS = "epoch_us({}) * 1000"
TICKS = """ticks AS (
  SELECT event_type AS instrument, epoch_us(ts) * 1000 AS ts_utc_ns, round(1 + value / 10000, 6) AS bid,
         round(round(1 + value / 10000, 6) + (CAST(json_extract_string(props, '$.k') AS BIGINT) % 7) * 0.00001, 6) AS ask, event_id AS row_sequence, value
  FROM events)"""
BARS = TICKS + """, held AS (
  SELECT *, ts_utc_ns - ts_utc_ns % 60000000000 AS minute, ask - bid AS spread,
         coalesce(lead(ts_utc_ns) OVER (PARTITION BY instrument, ts_utc_ns - ts_utc_ns % 60000000000 ORDER BY ts_utc_ns, row_sequence), ts_utc_ns - ts_utc_ns % 60000000000 + 60000000000) - ts_utc_ns AS w
  FROM ticks), raw_bars AS (
  SELECT instrument, minute AS ts_utc_ns, first(bid ORDER BY ts_utc_ns, row_sequence) AS bid_o, max(bid) AS bid_h, min(bid) AS bid_l, last(bid ORDER BY ts_utc_ns, row_sequence) AS bid_c,
         first(ask ORDER BY ts_utc_ns, row_sequence) AS ask_o, max(ask) AS ask_h, min(ask) AS ask_l, last(ask ORDER BY ts_utc_ns, row_sequence) AS ask_c, count(*) AS tick_count,
         min(ts_utc_ns) AS first_tick_ns, max(ts_utc_ns) AS last_tick_ns, first(spread ORDER BY ts_utc_ns, row_sequence) AS spread_open, max(spread) AS spread_max,
         sum(spread * w) / (minute + 60000000000 - min(ts_utc_ns)) AS spread_twa
  FROM held GROUP BY instrument, minute), bars AS (
  SELECT *, first_tick_ns - lag(last_tick_ns) OVER (PARTITION BY instrument, date_trunc('month', make_timestamp(ts_utc_ns // 1000)) ORDER BY ts_utc_ns) AS prev_gap_ns,
         (bid_c + ask_c) / 2 AS mid, row_number() OVER (PARTITION BY instrument ORDER BY ts_utc_ns) - 1 AS rn
  FROM raw_bars)"""


def local(ns: str, zone: str) -> str:
    return f"timezone('{zone}', timezone('UTC', make_timestamp(({ns}) // 1000)))"


def day_of(ns: str) -> str:
    return f"CAST({local(ns, 'America/New_York')} + INTERVAL 7 HOUR AS DATE)"


def at_local(day: str, hours: str, zone: str) -> str:
    return f"(epoch_us(timezone('{zone}', CAST({day} AS TIMESTAMP) + INTERVAL '{hours}')) * 1000)"


def weekend(ns: str) -> str:
    w = local(ns, "America/New_York")
    return f"(isodow({w}) = 6 OR (isodow({w}) = 5 AND hour({w}) >= 17) OR (isodow({w}) = 7 AND hour({w}) < 17))"


WINDOWS = f"""spine AS (
  SELECT instrument, CAST(unnest(generate_series(min({day_of('ts_utc_ns')}), max({day_of('ts_utc_ns')}), INTERVAL 1 DAY)) AS DATE) AS day FROM bars GROUP BY instrument), windows0 AS (
  SELECT instrument, day, 'tokyo' AS session, {at_local('day', '9 hours', 'Asia/Tokyo')} AS start_ns, {at_local('day', '15 hours', 'Asia/Tokyo')} AS end_ns FROM spine
  UNION ALL SELECT instrument, day, 'pre_london', {at_local('day', '0 hours', 'Europe/London')}, {at_local('day', '8 hours', 'Europe/London')} FROM spine
  UNION ALL SELECT instrument, day, 'london', {at_local('day', '8 hours', 'Europe/London')}, {at_local('day', '16 hours 30 minutes', 'Europe/London')} FROM spine
  UNION ALL SELECT instrument, day, 'london_open_window', {at_local('day', '8 hours', 'Europe/London')}, {at_local('day', '11 hours', 'Europe/London')} FROM spine
  UNION ALL SELECT instrument, day, 'new_york', {at_local('day', '8 hours', 'America/New_York')}, {at_local('day', '17 hours', 'America/New_York')} FROM spine), windows1 AS (
  SELECT * FROM windows0 UNION ALL
  SELECT a.instrument, a.day, 'overlap_london_ny', greatest(a.start_ns, b.start_ns), greatest(greatest(a.start_ns, b.start_ns), least(a.end_ns, b.end_ns))
  FROM windows0 a JOIN windows0 b USING (instrument, day) WHERE a.session = 'london' AND b.session = 'new_york'), windows AS (
  SELECT *, start_ns < end_ns AND ({weekend('start_ns')} OR {weekend('(end_ns - 1)')} OR {weekend('(start_ns + (end_ns - start_ns) // 2)')}) AS partial FROM windows1), stats AS (
  SELECT w.instrument, w.day, w.session, max(b.mid) AS high, min(b.mid) AS low, count(*) AS n_bars
  FROM windows w JOIN bars b ON b.instrument = w.instrument AND {day_of('b.ts_utc_ns')} = w.day AND b.ts_utc_ns >= w.start_ns AND b.ts_utc_ns < w.end_ns GROUP BY ALL), days AS (
  SELECT w.instrument, w.day, w.session, w.start_ns, w.end_ns, w.partial, s.high, s.low, s.high - s.low AS range, coalesce(s.n_bars, 0) AS n_bars,
         (SELECT max(ts_utc_ns) FROM bars b WHERE b.instrument = w.instrument) >= w.end_ns AS observed
  FROM windows w LEFT JOIN stats s USING (instrument, day, session))"""


def atr_sql(n: int) -> str:
    """CTEs after BARS: atr(instrument, ts_utc_ns, rn, atr_bars)."""
    return f"""tr AS (
  SELECT instrument, ts_utc_ns, rn, greatest(bid_h - bid_l, abs(bid_h - lag(bid_c) OVER o), abs(bid_l - lag(bid_c) OVER o)) AS tr FROM bars WINDOW o AS (PARTITION BY instrument ORDER BY rn)), fed AS (
  SELECT instrument, ts_utc_ns, rn, CASE WHEN rn = {n - 1} THEN (SELECT avg(u.tr) FROM tr u WHERE u.instrument = t.instrument AND u.rn < {n}) ELSE tr / {n} END AS x
  FROM tr t WHERE rn >= {n - 1}), atr AS (
  SELECT b.instrument, b.ts_utc_ns, b.rn, CASE WHEN b.rn >= {n - 1} THEN a.y END AS atr_bars FROM bars b LEFT JOIN (
    SELECT f.instrument, f.rn, sum(power({n - 1}.0 / {n}, f.rn - g.rn) * g.x) AS y FROM fed f JOIN fed g ON f.instrument = g.instrument AND g.rn <= f.rn AND g.rn > f.rn - {60 * n} GROUP BY ALL) a USING (instrument, rn))"""

"""Ticks, bars, time, sessions and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators import features as X
from tidemark.operators.bars import resample, resample_report, with_gaps
from tidemark.operators.sequence import numbered, trailing
from tidemark.operators.sessions import day_spine, days_between, membership, session_windows
from tidemark.queries.base import BARS, TICKS, WINDOWS, atr_sql, bars, day_of, local, place, rounded, ticks, weekend
from tidemark.sources import ticks as S

# 2024-01-08 and 2024-01-15, 00:00 UTC
LO, HI = 1_704_672_000_000_000_000, 1_705_276_800_000_000_000
ATR, PCT, RV, RV_GAP = 14, 5, 20, 60 * T.MINUTE
TEXT_DAY = "CAST(day AS VARCHAR)"
BAR_COLUMNS = "instrument, ts_utc_ns, bid_o, bid_h, bid_l, bid_c, ask_o, ask_h, ask_l, ask_c, tick_count, first_tick_ns, last_tick_ns, round(spread_open, 8) AS spread_open, round(spread_max, 8) AS spread_max, round(spread_twa, 8) AS spread_twa, prev_gap_ns"


def _day(df):
    return df.withColumn("day", F.col("day").cast("string"))


def op01(spark, sf):
    """Ticks written by instrument and month, and a range of them read back."""
    root = place(spark, "ticks")
    S.write_ticks(ticks(spark, sf).drop("value"), root)
    return S.read_ticks(spark, root, LO, HI).select("instrument", "ts_utc_ns", "bid", "ask", "row_sequence")


def op57(spark, sf):
    b = with_gaps(resample(ticks(spark, sf)))
    return rounded(b.select(*[c.strip().split(" AS ")[-1] for c in BAR_COLUMNS.replace("round(", "").replace(", 8)", "").split(",")]))


def op59(spark, sf):
    return with_gaps(resample(ticks(spark, sf)), continuous=True).select("instrument", "ts_utc_ns", "prev_gap_ns")


def op60(spark, sf):
    t = ticks(spark, sf).where(f"ts_utc_ns >= {LO} and ts_utc_ns < {HI}")
    return rounded(resample_report(t, resample(t), LO, HI))


def op28(spark, sf):
    w = {z: T.wall("ts_utc_ns", zone) for z, zone in (("ny", T.NEW_YORK), ("london", T.LONDON), ("tokyo", T.TOKYO))}
    return ticks(spark, sf).select("row_sequence", *(F.expr(f"unix_micros({e})").alias(f"{z}_wall_us") for z, e in w.items()))


def op31(spark, sf):
    d = ticks(spark, sf).withColumn("day", F.expr(T.trading_day("ts_utc_ns")))
    d = d.withColumn("week", F.expr(T.trading_week("day"))).withColumn("in_gap", F.expr(T.weekend_gap("ts_utc_ns"))).withColumn("start_ns", F.expr(T.day_start("day"))).withColumn("end_ns", F.expr(T.day_end("day")))
    return _day(d.select("row_sequence", "day", "week", F.col("in_gap").cast("long").alias("in_gap"), "start_ns", "end_ns"))


def op32(spark, sf):
    """The trading days of all shipping dates."""
    days = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.to_date("l_shipdate").alias("day")).distinct()
    return _day(days.withColumn("start_ns", F.expr(T.day_start("day"))).withColumn("end_ns", F.expr(T.day_end("day"))))


def op36(spark, sf):
    return rounded(ticks(spark, sf).groupBy(F.expr(T.iso_weekday("ts_utc_ns")).alias("weekday"), F.expr(T.local_hour("ts_utc_ns")).alias("hour"), F.expr(T.utc_year("ts_utc_ns")).alias("year")).agg(F.count(F.lit(1)).alias("n")))


def op38(spark, sf):
    return _day(session_windows(day_spine(bars(spark, sf))).select("instrument", "day", "session", "start_ns", "end_ns", F.col("partial").cast("long").alias("partial")))


def op41(spark, sf):
    b = bars(spark, sf)
    first, last = b.agg(F.min("ts_utc_ns"), F.max("ts_utc_ns")).select(*(F.expr(f"cast(date_add({T.trading_day(c)}, {d}) as string)") for c, d in (("`min(ts_utc_ns)`", -1), ("`max(ts_utc_ns)`", 1)))).first()
    return membership(b.select("instrument", "ts_utc_ns"), session_windows(days_between(spark, first, last))).select("instrument", "ts_utc_ns", F.concat_ws(",", "sessions").alias("sessions"))


def op44(spark, sf):
    return rounded(X.with_mid(bars(spark, sf)).select("instrument", "ts_utc_ns", "mid", (F.col("ask_c") - F.col("bid_c")).alias("spread")))


def op46(spark, sf):
    return rounded(X.log_returns(bars(spark, sf)).select("instrument", "ts_utc_ns", "ret"))


def op47(spark, sf):
    return rounded(X.true_range(bars(spark, sf)).select("instrument", "ts_utc_ns", "tr"))


def op61(spark, sf):
    return _day(rounded(X.session_days(bars(spark, sf)).select("instrument", "day", "session", "high", "low", "range", "n_bars", F.col("observed").cast("long").alias("observed"))))


def op79(spark, sf):
    return rounded(X.wilder_atr(bars(spark, sf)).select("instrument", "ts_utc_ns", "atr_bars"))


def op80(spark, sf):
    """Bars are minutes apart here, so gaps of up to an hour pass."""
    return rounded(X.realised_volatility(bars(spark, sf), gap_ns=RV_GAP).select("instrument", "ts_utc_ns", "rv_60m"))


def op81(spark, sf):
    return rounded(X.trailing_range(bars(spark, sf)).select("instrument", "ts_utc_ns", "range_60m"))


def op82(spark, sf):
    """One shared table of session days, four sessions' values made visible."""
    b = bars(spark, sf)
    return rounded(X.compute(["pre_london_high", "pre_london_low", "london_range", "new_york_range"], b))


def op85(spark, sf):
    """Of 60 days, so on days of lineitem: a return flag is an instrument, the day's prices are its range; every 11th day has no bars."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("instrument"), F.to_date("l_shipdate").alias("day")).agg((F.max("l_extendedprice") - F.min("l_extendedprice")).alias("range"), F.count(F.lit(1)).alias("n"))
    days = li.select("instrument", "day", F.lit("pre_london").alias("session"), "range", F.when(F.expr("unix_date(day) % 11 = 0"), 0).otherwise(F.col("n")).alias("n_bars"), F.lit(True).alias("observed"))
    return _day(rounded(X.range_percentile(days).select("instrument", "day", "pct")))


def op85b(spark, sf):
    return rounded(X.compute(["pre_london_range_pct"], bars(spark, sf), params={"pre_london_range_pct": {"n": PCT}}))


def op86(spark, sf):
    b = bars(spark, sf)
    names = ["pre_london", "london", "new_york"]
    return _day(rounded(X.anchored(X.session_days(b, names=names), X.wilder_atr(b, ATR), "atr_bars", "atr", names).select("instrument", "day", "session", "atr")))


def op95(spark, sf):
    """As-of: each customer's order and the first later one at least 30 days on."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", F.expr("unix_micros(cast(o_orderdate as timestamp)) * 1000").alias("at"))
    found = X.first_at_or_after(o.withColumn("from", F.col("at") + 30 * T.DAY), "from", o, "at", ["o_custkey"], "next_at")
    return found.select("o_orderkey", "next_at")


def op95b(spark, sf):
    """As-of over all ticks of an instrument: the first tick from each one on whose number is a multiple of 50."""
    t = ticks(spark, sf)
    found = X.first_at_or_after(t.select("instrument", "row_sequence", "ts_utc_ns"), "ts_utc_ns", t.where("row_sequence % 50 = 0").select("instrument", F.col("ts_utc_ns").alias("at")), "at", ["instrument"], "next_at")
    return found.select("row_sequence", "next_at")


def op76(spark, sf):
    return rounded(X.null_counts(X.compute(["atr_bars", "rv_60m"], bars(spark, sf), params={"atr_bars": {"n": ATR}, "rv_60m": {"n": RV, "gap_ns": RV_GAP}})))


def op88(spark, sf):
    r = trailing(numbered(ticks(spark, sf), ["instrument"], "row_sequence", span=4096), ["instrument"], 1, lambda w: {"gap": F.col("ts_utc_ns") - F.lag("ts_utc_ns").over(w)})
    return r.select("row_sequence", "rn", "gap")


QUERIES = {
    "OP01_tick_scan": op01, "OP57_resample": op57, "OP59_continuous_gap": op59, "OP60_resample_report": op60, "OP28_local_wall": op28, "OP31_trading_day_week_gap": op31, "OP32_day_bounds": op32,
    "OP36_hour_of_week": op36, "OP38_session_windows": op38, "OP41_membership": op41, "OP44_mid_and_spread": op44, "OP46_log_return": op46, "OP47_true_range": op47, "OP61_session_extremes": op61,
    "OP76_null_counts": op76, "OP79_wilder_atr": op79, "OP80_realised_volatility": op80, "OP81_trailing_range": op81, "OP82_session_mask": op82, "OP85_range_percentile": op85,
    "OP85_visible_percentile": op85b, "OP86_anchored_value": op86, "OP88_consecutive_difference": op88, "OP95_forward_as_of": op95, "OP95_forward_as_of_ticks": op95b,
}


def _mask(session: str, value: str, name: str) -> str:
    return f"""{name}_f AS (SELECT instrument, day, end_ns, last_value({value} IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY day) AS v FROM {{days}} WHERE session = '{session}'),
  {name} AS (SELECT b.instrument, b.ts_utc_ns, p.v FROM bars b JOIN {name}_f d ON d.instrument = b.instrument AND d.day = {day_of('b.ts_utc_ns')}
    LEFT JOIN {name}_f p ON p.instrument = b.instrument AND p.day = CASE WHEN b.ts_utc_ns >= d.end_ns THEN d.day ELSE CAST(d.day - INTERVAL 1 DAY AS DATE) END)"""


PCT_SQL = f"""eligible AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY day) AS k FROM days WHERE session = 'pre_london' AND n_bars > 0 AND observed),
  pct AS (SELECT a.instrument, a.day, CASE WHEN a.k > {PCT} THEN count(*) FILTER (b.range < a.range) / {PCT}.0 END AS pct
    FROM eligible a LEFT JOIN eligible b ON a.instrument = b.instrument AND b.k BETWEEN a.k - {PCT} AND a.k - 1 GROUP BY a.instrument, a.day, a.k)"""
ANCHOR_SQL = """anchored AS (SELECT d.instrument, d.day, d.session, d.end_ns, d.n_bars, d.observed, d.range, CASE WHEN d.n_bars > 0 THEN a.atr_bars END AS atr
    FROM (SELECT * FROM days WHERE session IN ('pre_london', 'london', 'new_york')) d ASOF LEFT JOIN atr a ON d.instrument = a.instrument AND d.end_ns <= a.ts_utc_ns)"""
def _rv(n: int) -> str:
    return f"""rets AS (SELECT *, ln(mid) - lag(ln(mid)) OVER (PARTITION BY instrument ORDER BY rn) AS ret FROM bars), rv AS (
  SELECT instrument, ts_utc_ns, CASE WHEN rn >= {n} AND NOT coalesce(max(prev_gap_ns) OVER w, 0) > {RV_GAP} THEN sqrt(sum(ret * ret) OVER w) END AS rv
  FROM rets WINDOW w AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"""


_RV = _rv(RV)
_NY = "'America/New_York'"
ORACLE_SQL = {
    "OP01_tick_scan": f"WITH {TICKS} SELECT instrument, ts_utc_ns, bid, ask, row_sequence FROM ticks WHERE ts_utc_ns >= {LO} AND ts_utc_ns < {HI}",
    "OP57_resample": f"WITH {BARS} SELECT {BAR_COLUMNS} FROM bars",
    "OP59_continuous_gap": f"WITH {BARS} SELECT instrument, ts_utc_ns, first_tick_ns - lag(last_tick_ns) OVER (PARTITION BY instrument ORDER BY ts_utc_ns) AS prev_gap_ns FROM bars",
    "OP60_resample_report": f"""WITH {BARS} SELECT instrument, CAST(1 AS BIGINT) AS months_expected, count(DISTINCT date_trunc('month', make_timestamp(first_tick_ns // 1000))) AS months_present, CAST(1 AS BIGINT) - count(DISTINCT date_trunc('month', make_timestamp(first_tick_ns // 1000))) AS months_missing,
      CAST(sum(tick_count) AS BIGINT) AS ticks, count(*) AS bars, {(HI - LO) // T.MINUTE} - count(*) AS minutes_absent FROM bars WHERE ts_utc_ns >= {LO} AND ts_utc_ns < {HI} GROUP BY instrument""",
    "OP28_local_wall": f"WITH {TICKS} SELECT row_sequence, epoch_us({local('ts_utc_ns', 'America/New_York')}) AS ny_wall_us, epoch_us({local('ts_utc_ns', 'Europe/London')}) AS london_wall_us, epoch_us({local('ts_utc_ns', 'Asia/Tokyo')}) AS tokyo_wall_us FROM ticks",
    "OP31_trading_day_week_gap": f"""WITH {TICKS}, d AS (SELECT *, {day_of('ts_utc_ns')} AS day FROM ticks), w AS (SELECT *, day + CAST(CASE WHEN isodow(day) <= 5 THEN 3 - isodow(day) ELSE 10 - isodow(day) END AS INTEGER) AS wed FROM d)
      SELECT row_sequence, {TEXT_DAY} AS day, printf('%04d-W%02d', isoyear(wed), weekofyear(wed)) AS week, CAST({weekend('ts_utc_ns')} AS BIGINT) AS in_gap,
      epoch_us(timezone({_NY}, CAST(day AS TIMESTAMP) - INTERVAL 7 HOUR)) * 1000 AS start_ns, epoch_us(timezone({_NY}, CAST(day AS TIMESTAMP) + INTERVAL 17 HOUR)) * 1000 AS end_ns FROM w""",
    "OP32_day_bounds": f"SELECT {TEXT_DAY} AS day, epoch_us(timezone({_NY}, CAST(day AS TIMESTAMP) - INTERVAL 7 HOUR)) * 1000 AS start_ns, epoch_us(timezone({_NY}, CAST(day AS TIMESTAMP) + INTERVAL 17 HOUR)) * 1000 AS end_ns FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)",
    "OP36_hour_of_week": f"WITH {TICKS} SELECT isodow({local('ts_utc_ns', 'Europe/London')}) AS weekday, hour({local('ts_utc_ns', 'Europe/London')}) AS hour, year(make_timestamp(ts_utc_ns // 1000)) AS year, count(*) AS n FROM ticks GROUP BY ALL",
    "OP38_session_windows": f"WITH {BARS}, {WINDOWS} SELECT instrument, {TEXT_DAY} AS day, session, start_ns, end_ns, CAST(partial AS BIGINT) AS partial FROM windows",
    "OP41_membership": f"WITH {BARS}, {WINDOWS} SELECT b.instrument, b.ts_utc_ns, coalesce(string_agg(w.session, ',' ORDER BY w.session), '') AS sessions FROM bars b LEFT JOIN windows w ON w.instrument = b.instrument AND w.day = {day_of('b.ts_utc_ns')} AND b.ts_utc_ns >= w.start_ns AND b.ts_utc_ns < w.end_ns GROUP BY ALL",
    "OP44_mid_and_spread": f"WITH {BARS} SELECT instrument, ts_utc_ns, round(mid, 8) AS mid, round(ask_c - bid_c, 8) + 0.0 AS spread FROM bars",
    "OP46_log_return": f"WITH {BARS} SELECT instrument, ts_utc_ns, round(ln(mid) - lag(ln(mid)) OVER (PARTITION BY instrument ORDER BY rn), 8) + 0.0 AS ret FROM bars",
    "OP47_true_range": f"WITH {BARS} SELECT instrument, ts_utc_ns, round(greatest(bid_h - bid_l, abs(bid_h - lag(bid_c) OVER o), abs(bid_l - lag(bid_c) OVER o)), 8) AS tr FROM bars WINDOW o AS (PARTITION BY instrument ORDER BY rn)",
    "OP61_session_extremes": f"WITH {BARS}, {WINDOWS} SELECT instrument, {TEXT_DAY} AS day, session, round(high, 8) AS high, round(low, 8) AS low, round(range, 8) AS range, n_bars, CAST(observed AS BIGINT) AS observed FROM days",
    "OP76_null_counts": f"WITH {BARS}, {atr_sql(ATR)}, {_RV} SELECT 'atr_bars' AS feature, count(*) - count(atr_bars) AS n_null FROM atr UNION ALL SELECT 'rv_60m', count(*) - count(rv) FROM rv",
    "OP79_wilder_atr": f"WITH {BARS}, {atr_sql(1440)} SELECT instrument, ts_utc_ns, round(atr_bars, 8) AS atr_bars FROM atr",
    "OP80_realised_volatility": f"WITH {BARS}, {_rv(60)} SELECT instrument, ts_utc_ns, round(rv, 8) AS rv_60m FROM rv",
    "OP81_trailing_range": f"WITH {BARS} SELECT instrument, ts_utc_ns, CASE WHEN rn >= 59 THEN round(max(mid) OVER w - min(mid) OVER w, 8) END AS range_60m FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
    "OP82_session_mask": f"WITH {BARS}, {WINDOWS}, " + ", ".join(_mask(s, v, n).format(days="days") for s, v, n in (("pre_london", "high", "ph"), ("pre_london", "low", "pl"), ("london", "range", "lr"), ("new_york", "range", "nr")))
    + " SELECT instrument, ts_utc_ns, round(ph.v, 8) AS pre_london_high, round(pl.v, 8) AS pre_london_low, round(lr.v, 8) AS london_range, round(nr.v, 8) AS new_york_range FROM ph JOIN pl USING (instrument, ts_utc_ns) JOIN lr USING (instrument, ts_utc_ns) JOIN nr USING (instrument, ts_utc_ns)",
    "OP85_range_percentile": """WITH d AS (SELECT l_returnflag AS instrument, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice) - min(l_extendedprice) AS range FROM lineitem GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY day) AS k FROM d WHERE (day - DATE '1970-01-01') % 11 <> 0),
      p AS (SELECT a.instrument, a.day, CASE WHEN a.k > 60 THEN count(*) FILTER (b.range < a.range) / 60.0 END AS pct FROM e a LEFT JOIN e b ON a.instrument = b.instrument AND b.k BETWEEN a.k - 60 AND a.k - 1 GROUP BY a.instrument, a.day, a.k) SELECT d.instrument, CAST(d.day AS VARCHAR) AS day, round(pct, 8) AS pct FROM d LEFT JOIN p USING (instrument, day)""",
    "OP85_visible_percentile": f"WITH {BARS}, {WINDOWS}, {PCT_SQL}, ranked AS (SELECT d.instrument, d.day, d.session, d.end_ns, p.pct FROM days d LEFT JOIN pct p USING (instrument, day) WHERE d.session = 'pre_london'), {_mask('pre_london', 'pct', 'pp').format(days='ranked')} SELECT instrument, ts_utc_ns, round(v, 8) AS pre_london_range_pct FROM pp",
    "OP86_anchored_value": f"WITH {BARS}, {WINDOWS}, {atr_sql(ATR)}, {ANCHOR_SQL} SELECT instrument, CAST(day AS VARCHAR) AS day, session, round(atr, 8) AS atr FROM anchored",
    "OP88_consecutive_difference": f"WITH {TICKS} SELECT row_sequence, row_number() OVER o - 1 AS rn, ts_utc_ns - lag(ts_utc_ns) OVER o AS gap FROM ticks WINDOW o AS (PARTITION BY instrument ORDER BY row_sequence)",
    "OP95_forward_as_of_ticks": f"WITH {TICKS}, r AS (SELECT instrument, ts_utc_ns AS at FROM ticks WHERE row_sequence % 50 = 0) SELECT t.row_sequence, r.at AS next_at FROM ticks t ASOF LEFT JOIN r ON t.instrument = r.instrument AND t.ts_utc_ns <= r.at",
    "OP95_forward_as_of": "WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) * 1000 AS at FROM orders) SELECT a.o_orderkey, min(b.at) AS next_at FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.at >= a.at + 2592000000000000 GROUP BY a.o_orderkey",
}

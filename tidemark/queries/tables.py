"""Stores, merges, ingestion helpers, set operations and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators import ingest as I
from tidemark.operators.bars import resample
from tidemark.queries.base import BARS, TICKS, atr_sql, bars, day_of, place, rounded, table, ticks
from tidemark.sources import ticks as S
from tidemark.sources.versions import VersionedTable
from tidemark.streaming.bars import bounded_bars
from tidemark.streaming.continued import bounded_continued

ATR = 14

LO, HI = 1_704_067_200_000_000_000, 1_735_689_600_000_000_000  # 2024, UTC


def op03(spark, sf):
    """The months from each customer's first order to the last."""
    at = F.expr("unix_micros(cast(o_orderdate as timestamp)) * 1000")
    spans = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(at).alias("start_ns"), (F.max(at) + T.DAY).alias("end_ns"))
    return rounded(S.months_of(spans, "start_ns", "end_ns").select("o_custkey", "year", "month"))


def op04(spark, sf):
    return rounded(S.missing_months(spark, S.with_month(ticks(spark, sf)), LO, HI, ["click", "view", "none"]))


def op16(spark, sf):
    """A second run with later ticks only replaces the minutes that it has."""
    t = ticks(spark, sf)
    first, second = S.with_month(resample(t.where("row_sequence % 3 <> 0"))), S.with_month(resample(t.where("row_sequence % 3 = 0")))
    merged = S.merge_bars(first.withColumn("prev_gap_ns", F.lit(0).cast("long")), second.withColumn("prev_gap_ns", F.lit(0).cast("long")))
    return rounded(merged.select("instrument", "ts_utc_ns", "tick_count", "bid_o", "prev_gap_ns"))


def op21(spark, sf):
    """The same two runs as versions of a table: each is there whole."""
    t = ticks(spark, sf)
    stored = VersionedTable.of_bars(spark, place(spark, "versions"))
    for own in ("row_sequence % 3 <> 0", "row_sequence % 3 = 0"):
        stored.upsert(resample(t.where(own)).withColumn("prev_gap_ns", F.lit(None).cast("long")))
    return rounded(stored.read().select("instrument", "ts_utc_ns", "tick_count", "bid_o", "prev_gap_ns"))


def op17(spark, sf):
    t = ticks(spark, sf).drop("value")
    again = t.where("row_sequence % 5 = 0").withColumn("bid", F.when(F.col("row_sequence") % 10 == 0, F.round(F.col("bid") - 0.001, 6)).otherwise(F.col("bid")))
    twin = t.where("row_sequence % 7 = 0").withColumn("row_sequence", F.col("row_sequence") + 1_000_000)
    return S.merge_ticks(t.unionByName(twin), again).select("instrument", "ts_utc_ns", "row_sequence", "bid", "ask")


def op18(spark, sf):
    """Features of ticks, of which several may have one instant: each is a row of its own."""
    t = ticks(spark, sf).select("instrument", "ts_utc_ns", "row_sequence", F.col("bid").alias("x"))
    return S.merge_features(t, t.where("x > 1.002").withColumn("x", -F.col("x")), ("instrument", "ts_utc_ns", "row_sequence")).select("instrument", "ts_utc_ns", "x")


def op02(spark, sf):
    """Bars written by month and read back by range."""
    from tidemark.operators.bars import with_gaps

    root = place(spark, "bars")
    S.write_bars(with_gaps(resample(ticks(spark, sf))), root)
    lo, hi = 1_704_672_000_000_000_000, 1_705_276_800_000_000_000
    return rounded(S.read_bars(spark, root, lo, hi).select("instrument", "ts_utc_ns", "bid_c", "tick_count", "prev_gap_ns"))


def op13(spark, sf):
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.element_at(F.array(*(F.lit(x) for x in I.EVENT_TYPES)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("event_type"))
    return I.release_calendar(o).select(F.col("date").cast("string").alias("day"), F.concat_ws(",", "event_types").alias("kinds"))


def op99(spark, sf):
    """Calendar lookup: releases on the day of each tick."""
    kinds = I.release_calendar(table(spark, sf, "orders").select(F.expr("date_add(to_date(o_orderdate), 10500)").alias("date"), F.lit("nfp").alias("event_type")))
    t = ticks(spark, sf).withColumn("date", F.expr(T.trading_day("ts_utc_ns")))
    return t.join(kinds, "date", "left").select("row_sequence", F.col("event_types").isNotNull().cast("long").alias("is_release_day"))


def op127(spark, sf):
    """Days of orders on which New York's and London's clocks aren't five hours apart, with their orders."""
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return rounded(o.where(I.clocks_differ()).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")))


def op19(spark, sf):
    e = table(spark, sf, "events").select((F.expr("unix_micros(cast(ts as timestamp)) div 3600000000") * T.HOUR).alias("hour_ns"), "event_type")
    log = lambda kind, status: e.where(F.col("event_type") == kind).select("hour_ns").distinct().select("hour_ns", F.lit(status).alias("status"))
    new = log("click", "fetched").unionByName(log("signup", "skipped_existing").join(log("click", "x").select("hour_ns"), "hour_ns", "left_anti"))
    return I.merge_fetch_log(log("view", "empty"), new)


def op101(spark, sf):
    o = table(spark, sf, "orders")
    return S.latest(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


def op104(spark, sf):
    """First three orders of each priority by date: a top-k report."""
    return rounded(S.first_rows(table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], 3, "place").select("o_orderpriority", "place", "o_orderkey"))


def op96(spark, sf):
    """Bars of the days on which a tick of their instrument was far from the mean: a semi-join by day."""
    t = ticks(spark, sf).withColumn("day", F.expr(T.trading_day("ts_utc_ns")))
    far = t.where("value >= 130").select("instrument", "day")
    return S.rows_of(t, far, ["instrument", "day"]).select("row_sequence")


def op123(spark, sf):
    """Column order by the share of rows whose first price is larger, for whole instruments: one has its columns the other way round."""
    view = F.col("instrument") == "view"
    t = ticks(spark, sf).where("ask > bid").select("instrument", F.when(view, F.col("ask")).otherwise(F.col("bid")).alias("a"), F.when(view, F.col("bid")).otherwise(F.col("ask")).alias("b"))
    return rounded(I.column_orders(t, ["instrument"], "a", "b"))


def op_stream(spark, sf):
    """The stream over a folder of ticks, run until it has read all and given out its last minute."""
    root = place(spark, "stream")
    t = ticks(spark, sf).select("instrument", "ts_utc_ns", "bid", "ask", "row_sequence")
    t.write.parquet(f"{root}/in")
    return rounded(bounded_bars(spark, f"{root}/in", t.schema, f"{root}/out", f"{root}/state").select("instrument", "ts_utc_ns", "bid_o", "ask_c", "tick_count", "spread_twa"))


def op_continued(spark, sf):
    """Gaps and average true ranges of all bars, as a stream with a restart half way."""
    return rounded(bounded_continued(bars(spark, sf), place(spark, "continued"), ATR))


QUERIES = {
    "OP02_bar_store": op02, "OP03_months": op03, "OP04_holes": op04, "OP13_release_calendar": op13, "OP16_bar_merge": op16, "OP21_versioned_upsert": op21, "OP17_tick_merge": op17, "OP18_feature_merge": op18, "OP19_log_merge": op19, "OP96_semi_join": op96, "OP99_calendar_lookup": op99,
    "OP101_latest": op101, "OP104_first_rows": op104, "OP123_column_order": op123, "OP127_divergent_dates": op127, "EXT_streaming_bars": op_stream, "EXT_streaming_continued": op_continued,
}

_HOURS = "hours AS (SELECT DISTINCT epoch_us(ts) // 3600000000 * 3600000000000 AS hour_ns, event_type FROM events)"
_MONTH = "date_trunc('month', make_timestamp(ts_utc_ns // 1000))"


def _bars_of(name: str, test: str) -> str:
    """CTEs of BARS with other names, over the ticks that pass the test."""
    body = BARS.split("ticks AS (", 1)[1].split("FROM events)", 1)[1]
    for word in ("held", "raw_bars", "bars"):
        body = body.replace(f" {word} AS (", f" {word}_{name} AS (").replace(f"FROM {word})", f"FROM {word}_{name})").replace(f"FROM {word} GROUP", f"FROM {word}_{name} GROUP")
    return body.replace("FROM ticks)", f"FROM ticks WHERE {test})")


ORACLE_SQL = {
    "OP02_bar_store": f"WITH {BARS} SELECT instrument, ts_utc_ns, bid_c, tick_count, prev_gap_ns FROM bars WHERE ts_utc_ns >= 1704672000000000000 AND ts_utc_ns < 1705276800000000000",
    "OP03_months": """WITH s AS (SELECT o_custkey, min(o_orderdate)::TIMESTAMP AS lo, max(o_orderdate)::TIMESTAMP AS hi FROM orders GROUP BY 1), m AS (
      SELECT o_custkey, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS m FROM s) SELECT o_custkey, year(m) AS year, month(m) AS month FROM m""",
    "OP04_holes": f"WITH {TICKS} SELECT i.instrument, CAST(2024 AS BIGINT) AS year, m.month FROM (SELECT unnest(['click', 'view', 'none']) AS instrument) i, (SELECT unnest(generate_series(1, 12)) AS month) m WHERE NOT EXISTS (SELECT 1 FROM ticks t WHERE t.instrument = i.instrument AND month(make_timestamp(t.ts_utc_ns // 1000)) = m.month)",
    "OP13_release_calendar": "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, string_agg(DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'nfp' WHEN 1 THEN 'fomc' ELSE 'boe_mpc' END, ',' ORDER BY CASE o_orderkey % 3 WHEN 0 THEN 'nfp' WHEN 1 THEN 'fomc' ELSE 'boe_mpc' END) AS kinds FROM orders GROUP BY 1",
    "OP16_bar_merge": f"WITH {TICKS}{_bars_of('a', 'row_sequence % 3 <> 0')}{_bars_of('b', 'row_sequence % 3 = 0')}, merged AS (SELECT * FROM bars_b UNION ALL SELECT * FROM bars_a a WHERE NOT EXISTS (SELECT 1 FROM bars_b b WHERE a.instrument = b.instrument AND a.ts_utc_ns = b.ts_utc_ns)) SELECT instrument, ts_utc_ns, tick_count, round(bid_o, 8) AS bid_o, first_tick_ns - lag(last_tick_ns) OVER (PARTITION BY instrument, {_MONTH} ORDER BY ts_utc_ns) AS prev_gap_ns FROM merged",
    "OP17_tick_merge": f"""WITH {TICKS}, every AS (SELECT instrument, ts_utc_ns, bid, ask, row_sequence, 0 AS gen FROM ticks UNION ALL SELECT instrument, ts_utc_ns, bid, ask, row_sequence + 1000000, 0 FROM ticks WHERE row_sequence % 7 = 0
      UNION ALL SELECT instrument, ts_utc_ns, CASE WHEN row_sequence % 10 = 0 THEN round(bid - 0.001, 6) ELSE bid END, ask, row_sequence, 1 FROM ticks WHERE row_sequence % 5 = 0), once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY instrument, ts_utc_ns, bid, ask ORDER BY row_sequence DESC, gen DESC) = 1)
      SELECT instrument, ts_utc_ns, row_sequence, bid, ask FROM once QUALIFY row_number() OVER (PARTITION BY instrument, ts_utc_ns, row_sequence ORDER BY gen DESC) = 1""",
    "OP18_feature_merge": f"WITH {TICKS} SELECT instrument, ts_utc_ns, CASE WHEN bid > 1.002 THEN -bid ELSE bid END AS x FROM ticks",
    "OP19_log_merge": f"WITH {_HOURS} SELECT hour_ns, CASE WHEN bool_or(event_type = 'click') THEN 'fetched' ELSE 'empty' END AS status FROM hours WHERE event_type IN ('click', 'view') GROUP BY 1",
    "EXT_streaming_bars": f"WITH {BARS} SELECT instrument, ts_utc_ns, round(bid_o, 8) AS bid_o, round(ask_c, 8) AS ask_c, tick_count, round(spread_twa, 8) AS spread_twa FROM bars",
    "OP96_semi_join": f"WITH {TICKS}, d AS (SELECT *, {day_of('ts_utc_ns')} AS day FROM ticks) SELECT row_sequence FROM d WHERE (instrument, day) IN (SELECT (instrument, day) FROM d WHERE value >= 130)",
    "OP99_calendar_lookup": f"WITH {TICKS}, cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) + 10500 AS d FROM orders) SELECT row_sequence, CAST(CAST(timezone('America/New_York', timezone('UTC', make_timestamp(ts_utc_ns // 1000))) + INTERVAL 7 HOUR AS DATE) IN (SELECT d FROM cal) AS BIGINT) AS is_release_day FROM ticks",
    "OP101_latest": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "OP104_first_rows": "SELECT o_orderpriority, row_number() OVER w AS place, o_orderkey FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) QUALIFY row_number() OVER w <= 3",
    "OP123_column_order": f"WITH {TICKS}, t AS (SELECT instrument, CASE WHEN instrument = 'view' THEN ask ELSE bid END AS a, CASE WHEN instrument = 'view' THEN bid ELSE ask END AS b FROM ticks WHERE ask > bid), s AS (SELECT instrument, avg(CAST(a > b AS INT)) AS share, count(*) AS n FROM t GROUP BY 1) SELECT instrument, n, share, CASE WHEN share <= 0.01 THEN 'bid_ask' WHEN share >= 0.99 THEN 'ask_bid' END AS column_order FROM s",
    "OP127_divergent_dates": "SELECT CAST(d AS VARCHAR) AS day, count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) WHERE timezone('America/New_York', CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR) - timezone('Europe/London', CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR) <> INTERVAL 5 HOUR GROUP BY d",
}
ORACLE_SQL["OP21_versioned_upsert"] = ORACLE_SQL["OP16_bar_merge"]  # the same rows, read back
ORACLE_SQL["EXT_streaming_continued"] = f"WITH {BARS}, {atr_sql(ATR)} SELECT b.instrument, b.ts_utc_ns, b.first_tick_ns - lag(b.last_tick_ns) OVER (PARTITION BY b.instrument ORDER BY b.ts_utc_ns) AS prev_gap_ns, round(a.atr_bars, 8) AS atr_bars FROM bars b JOIN atr a USING (instrument, ts_utc_ns)"

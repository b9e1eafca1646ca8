"""What the blueprint lists as specified only: further features, reports R3, R4 and R6, order fills, trade statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators import execution as X
from tidemark.operators import statistics as ST
from tidemark.operators import study as S
from tidemark.queries.base import BARS, TICKS, WINDOWS, bars, day_of, local, rounded, table, ticks
from tidemark.queries.market import _RV, RV, RV_GAP
from tidemark.queries.research import _EVENTS, P

GAP = 60 * T.MINUTE


def returns(spark, sf):
    return rounded(S.returns(bars(spark, sf), gap_ns=GAP).select("instrument", "ts_utc_ns", "ret_1m", "ret_5m", "ret_15m", "ret_60m"))


def calendar(spark, sf):
    return rounded(S.calendar(bars(spark, sf)).select("instrument", "ts_utc_ns", "hour_of_day_london", "day_of_week_trading", "minutes_into_trading_day"))


def previous(spark, sf):
    return rounded(S.previous_days(bars(spark, sf)).select("instrument", "ts_utc_ns", "prev_day_high", "prev_day_low", "prev_day_close", "prev_week_high", "prev_week_low"))


def position(spark, sf):
    return rounded(S.close_position(bars(spark, sf)).select("instrument", F.col("day").cast("string").alias("day"), "close_position"))


def state(spark, sf):
    s = S.session_state(bars(spark, sf)).select("instrument", "ts_utc_ns", F.explode("states").alias("session", "since"))
    return s.select("instrument", "ts_utc_ns", "session", "since")


def spread(spark, sf):
    return rounded(S.spread_percentile(bars(spark, sf)).select("instrument", "ts_utc_ns", "spread_pct"))


def ratio(spark, sf):
    return rounded(S.rv_ratio(bars(spark, sf), RV, RV_GAP).select("instrument", "ts_utc_ns", "rv_ratio"))


def r3(spark, sf):
    return rounded(S.break_and_hold(bars(spark, sf), P))


def r4(spark, sf):
    return rounded(S.extreme_hours(bars(spark, sf)))


def r6(spark, sf):
    return rounded(S.volatility_by_year(bars(spark, sf), RV, RV_GAP))


def _orders(spark, sf):
    """Every tick places an order from its own instant on, for six hours, near the price of its time."""
    t = ticks(spark, sf)
    k = F.expr("row_sequence % 6")
    kind = F.when(k < 2, "market").when(k < 4, "stop").otherwise("limit")
    side = F.when(F.expr("row_sequence % 2 = 0"), "buy").otherwise("sell")
    away = F.when(side == "buy", 0.0005).otherwise(-0.0005)
    level = F.round(F.when(kind == "limit", F.col("bid") - away).otherwise(F.col("bid") + away), 6)
    return t.select(F.col("row_sequence").cast("string").alias("order_id"), "instrument", kind.alias("kind"), side.alias("side"), level.alias("level"), F.col("ts_utc_ns").alias("from_ns"), (F.col("ts_utc_ns") + 6 * T.HOUR).alias("until_ns"), F.when(kind == "limit", 0.0).otherwise(0.00001).alias("slip"))


def fills(spark, sf):
    return rounded(X.fills(_orders(spark, sf), ticks(spark, sf)).select("order_id", "fill_ns", "fill_price"))


def _trades(spark, sf):
    """Orders as trades of their customers: a result for each, around 0."""
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 20).alias("run"), F.col("o_orderkey").alias("at"), F.round((F.col("o_totalprice") % 100) / 20 - 2.4, 6).alias("r_net"))


def summary(spark, sf):
    return rounded(ST.summary(_trades(spark, sf)), 6)


def intervals(spark, sf):
    return rounded(ST.intervals(_trades(spark, sf), 7, 500), 6)


def r_multiples(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("trade_id"), F.when(F.col("p_partkey") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("p_retailprice").alias("entry_price"), (F.col("p_retailprice") + F.col("p_size") - 25).alias("exit_price"), F.col("p_retailprice").alias("entry_reference"), (F.col("p_retailprice") - F.col("p_size") % 10).alias("stop_reference"))
    return rounded(X.r_multiples(p, 0.5).select("trade_id", "r_gross", "r_net"), 6)


QUERIES = {
    "SPEC_returns": returns, "SPEC_calendar_features": calendar, "SPEC_previous_days_and_weeks": previous, "SPEC_close_position": position, "SPEC_session_state": state, "SPEC_spread_percentile": spread, "SPEC_rv_ratio": ratio,
    "SPEC_R3_break_and_hold": r3, "SPEC_R4_extreme_hours": r4, "SPEC_R6_volatility_by_year": r6, "SPEC_fills": fills, "SPEC_trade_summary": summary, "SPEC_trade_intervals": intervals, "SPEC_r_multiples": r_multiples,
}

_Z = S.Z95


def _wilson(hits: str, n: str) -> tuple[str, str]:
    centre, half = f"({hits} / {n} + {_Z**2} / (2 * {n}))", f"{_Z} * sqrt(({hits} / {n}) * (1 - {hits} / {n}) / {n} + {_Z**2} / (4.0 * {n} * {n}))"
    return f"({centre} - {half}) / (1 + {_Z**2} / {n})", f"({centre} + {half}) / (1 + {_Z**2} / {n})"


_ret = lambda k: f"ln(mid) - lag(ln(mid), {k}) OVER o"
_LO, _HI = _wilson("held", "n")
_LO4, _HI4 = _wilson("n", "of_n")
_LOW, _HIW = _wilson("wins", "n")
_LONDON_HOUR = f"hour({local('ts_utc_ns', 'Europe/London')})"
_SLOT = "datediff('day', b.day, a.day) BETWEEN 1 AND 28"
_ORDERS = """orders_x AS (SELECT CAST(row_sequence AS VARCHAR) AS order_id, instrument, CASE WHEN row_sequence % 6 < 2 THEN 'market' WHEN row_sequence % 6 < 4 THEN 'stop' ELSE 'limit' END AS kind,
  CASE WHEN row_sequence % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, bid AS b0, ts_utc_ns AS from_ns, ts_utc_ns + 21600000000000 AS until_ns FROM ticks), placed AS (
  SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS s, CASE WHEN kind = 'limit' THEN 0.0 ELSE 0.00001 END AS slip, round(CASE WHEN kind = 'limit' THEN b0 - CASE WHEN side = 'buy' THEN 0.0005 ELSE -0.0005 END ELSE b0 + CASE WHEN side = 'buy' THEN 0.0005 ELSE -0.0005 END END, 6) AS level FROM orders_x), seen AS (
  SELECT p.order_id, p.kind, p.s, p.slip, p.level, t.ts_utc_ns, t.row_sequence, CASE WHEN p.side = 'buy' THEN t.ask ELSE t.bid END AS price FROM placed p JOIN ticks t ON t.instrument = p.instrument AND t.ts_utc_ns >= p.from_ns AND t.ts_utc_ns < p.until_ns), hit AS (
  SELECT *, CASE kind WHEN 'market' THEN price WHEN 'stop' THEN CASE WHEN s = 1 THEN greatest(level, price) ELSE least(level, price) END ELSE CASE WHEN s = 1 THEN least(level, price) ELSE greatest(level, price) END END + s * slip AS fill
  FROM seen WHERE kind = 'market' OR (kind = 'stop' AND s * (price - level) >= 0) OR (kind = 'limit' AND s * (price - level) < 0) QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts_utc_ns, row_sequence) = 1)"""
ORACLE_SQL = {
    "SPEC_returns": f"WITH {BARS} SELECT instrument, ts_utc_ns, CASE WHEN NOT coalesce(prev_gap_ns, 0) > {GAP} THEN round({_ret(1)}, 8) + 0.0 END AS ret_1m, round({_ret(5)}, 8) + 0.0 AS ret_5m, round({_ret(15)}, 8) + 0.0 AS ret_15m, round({_ret(60)}, 8) + 0.0 AS ret_60m FROM bars WINDOW o AS (PARTITION BY instrument ORDER BY rn)",
    "SPEC_calendar_features": f"WITH {BARS}, d AS (SELECT *, {day_of('ts_utc_ns')} AS day FROM bars) SELECT instrument, ts_utc_ns, {_LONDON_HOUR} AS hour_of_day_london, isodow(day) AS day_of_week_trading, (ts_utc_ns - epoch_us(timezone('America/New_York', CAST(day AS TIMESTAMP) - INTERVAL 7 HOUR)) * 1000) // 60000000000 AS minutes_into_trading_day FROM d",
    "SPEC_previous_days_and_weeks": f"""WITH {BARS}, d AS (SELECT *, {day_of('ts_utc_ns')} AS day FROM bars), w AS (SELECT *, CAST(date_trunc('week', day + 2) AS DATE) AS week FROM d), daily AS (SELECT instrument, day, max(mid) AS h, min(mid) AS l, last(mid ORDER BY ts_utc_ns) AS c FROM w GROUP BY ALL), weekly AS (SELECT instrument, week, max(mid) AS h, min(mid) AS l FROM w GROUP BY ALL),
      pd AS (SELECT instrument, day, lag(h) OVER o AS h, lag(l) OVER o AS l, lag(c) OVER o AS c FROM daily WINDOW o AS (PARTITION BY instrument ORDER BY day)), pw AS (SELECT instrument, week, lag(h) OVER o AS h, lag(l) OVER o AS l FROM weekly WINDOW o AS (PARTITION BY instrument ORDER BY week))
      SELECT w.instrument, w.ts_utc_ns, round(pd.h, 8) AS prev_day_high, round(pd.l, 8) AS prev_day_low, round(pd.c, 8) AS prev_day_close, round(pw.h, 8) AS prev_week_high, round(pw.l, 8) AS prev_week_low FROM w JOIN pd USING (instrument, day) JOIN pw USING (instrument, week)""",
    "SPEC_close_position": f"WITH {BARS}, {WINDOWS} SELECT d.instrument, CAST(d.day AS VARCHAR) AS day, round((last(b.mid ORDER BY b.ts_utc_ns) - min(b.mid)) / nullif(max(b.mid) - min(b.mid), 0), 8) AS close_position FROM days d JOIN bars b ON b.instrument = d.instrument AND {day_of('b.ts_utc_ns')} = d.day AND b.ts_utc_ns >= d.start_ns AND b.ts_utc_ns < d.end_ns WHERE d.session = 'pre_london' GROUP BY d.instrument, d.day",
    "SPEC_session_state": f"WITH {BARS}, {WINDOWS} SELECT b.instrument, b.ts_utc_ns, w.session, b.ts_utc_ns - w.start_ns AS since FROM bars b JOIN windows w ON w.instrument = b.instrument AND w.day = {day_of('b.ts_utc_ns')} AND b.ts_utc_ns >= w.start_ns AND b.ts_utc_ns < w.end_ns",
    "SPEC_spread_percentile": f"WITH {BARS}, d AS (SELECT *, {day_of('ts_utc_ns')} AS day, {_LONDON_HOUR} AS hour FROM bars) SELECT a.instrument, a.ts_utc_ns, round(count(b.spread_twa) FILTER (b.spread_twa < a.spread_twa) / nullif(count(b.spread_twa), 0), 8) AS spread_pct FROM d a LEFT JOIN d b ON a.instrument = b.instrument AND a.hour = b.hour AND isodow(a.day) = isodow(b.day) AND {_SLOT} GROUP BY ALL",
    "SPEC_rv_ratio": f"WITH {BARS}, {_RV}, d AS (SELECT *, {day_of('ts_utc_ns')} AS day, {_LONDON_HOUR} AS hour FROM rv) SELECT a.instrument, a.ts_utc_ns, round(any_value(a.rv) / nullif(quantile_cont(b.rv, 0.5), 0), 8) AS rv_ratio FROM d a LEFT JOIN d b ON a.instrument = b.instrument AND a.hour = b.hour AND {_SLOT} AND b.rv IS NOT NULL GROUP BY a.instrument, a.ts_utc_ns",
    "SPEC_R3_break_and_hold": f"""WITH {_EVENTS}, held_x AS (SELECT b.instrument, year(b.day) AS year, b.direction, k.k AS bars_after, CASE WHEN b.direction = 'long' THEN r.mid > b.high ELSE r.mid < b.low END AS ok FROM breaks b, (SELECT unnest([30, 60, 120]) AS k) k JOIN full_rows r ON r.instrument = b.instrument AND r.rn = b.rn + k.k), g AS (
      SELECT instrument, year, direction, bars_after, count(*) AS n, count(*) FILTER (ok) AS held FROM held_x GROUP BY ALL) SELECT instrument, year, direction, bars_after, n, held, round(held / n, 8) AS share, round({_LO}, 8) AS low, round({_HI}, 8) AS high FROM g""",
    "SPEC_R4_extreme_hours": f"""WITH {BARS}, d AS (SELECT *, {day_of('ts_utc_ns')} AS day FROM bars), e AS (SELECT instrument, day, first(ts_utc_ns ORDER BY mid DESC, ts_utc_ns) AS high, first(ts_utc_ns ORDER BY mid, ts_utc_ns) AS low, first(mid ORDER BY ts_utc_ns) AS o, last(mid ORDER BY ts_utc_ns) AS c FROM d GROUP BY ALL), x AS (
      SELECT *, 'high' AS extreme, high AS ts_utc_ns FROM e UNION ALL SELECT *, 'low', low FROM e), g AS (SELECT instrument, year(day) AS year, isodow(day) AS weekday, CASE WHEN c > o THEN 'up' ELSE 'down' END AS closed, extreme, {_LONDON_HOUR} AS hour, count(*) AS n FROM x GROUP BY ALL), t AS (
      SELECT *, sum(n) OVER (PARTITION BY instrument, year, weekday, closed, extreme) AS of_n FROM g) SELECT instrument, year, weekday, closed, extreme, hour, n, CAST(of_n AS BIGINT) AS "of", round(n / of_n, 8) AS share, round({_LO4}, 8) AS low, round({_HI4}, 8) AS high FROM t""",
    "SPEC_R6_volatility_by_year": f"WITH {BARS}, {_RV} SELECT instrument, year(make_timestamp(ts_utc_ns // 1000)) AS year, count(*) AS n, round(quantile_cont(rv, 0.25), 8) AS q1_rv, round(quantile_cont(rv, 0.5), 8) AS median_rv, round(quantile_cont(rv, 0.75), 8) AS q3_rv, CAST(NULL AS DOUBLE) AS to_year_before FROM rv WHERE rv IS NOT NULL GROUP BY ALL",
    "SPEC_fills": f"WITH {TICKS}, {_ORDERS} SELECT p.order_id, h.ts_utc_ns AS fill_ns, round(h.fill, 8) AS fill_price FROM placed p LEFT JOIN hit h USING (order_id)",
    "SPEC_trade_summary": f"""WITH t AS (SELECT o_custkey % 20 AS run, o_orderkey AS k, round((o_totalprice % 100) / 20 - 2.4, 6) AS r FROM orders), c AS (SELECT *, sum(r) OVER (PARTITION BY run ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM t), dd AS (SELECT *, greatest(max(c) OVER (PARTITION BY run ORDER BY k ROWS UNBOUNDED PRECEDING), 0) - c AS d FROM c), g AS (
      SELECT run, count(*) AS n, avg(r) AS e, count(*) FILTER (r > 0) AS wins, coalesce(sum(r) FILTER (r > 0), 0) / nullif(sum(-r) FILTER (r < 0), 0) AS pf, max(d) AS d FROM dd GROUP BY run)
      SELECT run, n, round(e, 6) + 0.0 AS expectancy_r, wins, round(pf, 6) AS profit_factor, round(d, 6) + 0.0 AS max_drawdown_r, round(wins / n, 6) AS win_rate, round({_LOW}, 6) AS win_low, round({_HIW}, 6) AS win_high FROM g""",
    "SPEC_r_multiples": "SELECT p_partkey AS trade_id, round(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END * ((p_retailprice + p_size - 25) - p_retailprice) / nullif(abs(p_retailprice - (p_retailprice - p_size % 10)), 0), 6) + 0.0 AS r_gross, round(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END * ((p_retailprice + p_size - 25) - p_retailprice) / nullif(abs(p_retailprice - (p_retailprice - p_size % 10)), 0) - 1.0 / nullif(abs(p_retailprice - (p_retailprice - p_size % 10)), 0), 6) + 0.0 AS r_net FROM part",
}

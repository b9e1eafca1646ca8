"""Robustness tests, forward records, regime aggregates, ambiguous bars: orders stand for trades, a customer's number for a run."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators import execution as X
from tidemark.operators import features as FX
from tidemark.operators import forward as V
from tidemark.operators import robustness as R
from tidemark.operators import study as S
from tidemark.queries.base import BARS, TICKS, WINDOWS, atr_sql, bars, day_of, rounded, table, ticks
from tidemark.queries.market import ANCHOR_SQL, ATR, RV, RV_GAP, _rv

#: A run for each customer modulo 20; the result of a trade is around 0.3.
_R = "round((o_totalprice % 100) / 20 - 2.2, 6)"


def trades(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    r = F.round((F.col("o_totalprice") % 100) / 20 - 2.2, 6)
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 20).alias("run"), k.alias("trade_id"), F.to_date("o_orderdate").alias("day"), k.alias("at"), F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"),
        r.alias("r_net"), F.round(F.lit(0.02) + (k % 5) / 100, 6).alias("cost_r"), (k % 9 == 0).alias("ambiguous"), F.least(r, F.lit(-1.0)).alias("r_worst"), (-r - 0.1).alias("r_opposite"))


def rt1(spark, sf):
    return rounded(R.by_year(trades(spark, sf)), 6)


def rt1p(spark, sf):
    h = R.years_hold(R.by_year(trades(spark, sf)))
    return rounded(h.withColumn("passed", F.col("passed").cast("long")), 6)


def rt2(spark, sf):
    return rounded(R.stressed(trades(spark, sf), "cost_r", R.COSTS), 6)


def rt5(spark, sf):
    """A variant for each remainder of a trade's number."""
    k = F.col("trade_id")
    v = trades(spark, sf).withColumns({"parameter": F.when(k % 2 == 0, "buffer").otherwise("length"), "value": F.element_at(F.array(*map(F.lit, (-0.2, -0.1, 0.0, 0.1, 0.2))), (k % 5 + 1).cast("int"))})
    return rounded(R.surface(v), 6)


def rt7(spark, sf):
    return rounded(R.without_best(trades(spark, sf)), 6)


def rt8(spark, sf):
    p = R.pessimistic(trades(spark, sf))
    return rounded(p.withColumn("passed", F.col("passed").cast("long")), 6)


def rt9(spark, sf):
    """Where a run's expectancy is against trades of drawn sides."""
    t = trades(spark, sf)
    e = R.envelope(t, R.placebo(t, 20260915))
    return rounded(e.withColumn("outside", F.col("outside").cast("long")), 6)


#: Each instrument's trading day is a scan window; a trade is left at the window's last bar. One R is this much of the price.
_RISK = 0.002


def _window(spark, sf) -> DataFrame:
    """Every bar of a trading day but the last as an entry: side by the day's number, result at the last bar."""
    b = FX.with_day(FX.with_mid(bars(spark, sf)))
    w = FX.W.partitionBy("instrument", "day").orderBy("ts_utc_ns")
    whole = w.rowsBetween(FX.W.unboundedPreceding, FX.W.unboundedFollowing)
    rows = b.withColumns({"slot": F.row_number().over(w) - 1, "n_slots": F.count(F.lit(1)).over(whole) - 1, "out_bid": F.last("bid_c").over(whole), "out_ask": F.last("ask_c").over(whole)}).where("slot < n_slots")
    side = F.when(F.day("day") % 2 == 0, "buy").otherwise("sell")
    gain = F.when(side == "buy", F.col("out_bid") - F.col("ask_c")).otherwise(F.col("bid_c") - F.col("out_ask"))
    return rows.select(F.col("instrument").alias("run"), "day", side.alias("side"), "slot", "n_slots", F.round(gain / _RISK, 6).alias("r_net"))


def rt10(spark, sf):
    """Against drawn entries: the trade enters a third into the day, the draw at any of its minutes that has a bar."""
    slots = _window(spark, sf)
    t = slots.where(F.col("slot") == F.floor(F.col("n_slots") / 3)).withColumn("trade_id", F.concat_ws("/", "run", F.col("day").cast("string")))
    e = R.envelope(t, R.random_timing(t, slots, 20260915))
    return rounded(e.withColumn("outside", F.col("outside").cast("long")), 6)


def _bounded(df: DataFrame) -> DataFrame:
    """A bound is interpolated between two results of a few trades, often halfway between two numbers of six digits."""
    return rounded(df.withColumn("expectancy_r", F.round("expectancy_r", 6)), 9)


def rt1_bounds(spark, sf):
    t = trades(spark, sf).withColumn("year", F.year("day"))
    return _bounded(R.lower_bounds(t, ["run", "year"], 20260915).drop("multiplier"))


def rt2_bounds(spark, sf):
    """Commission, spread and slippage, each on its own multipliers: an order's cost stands for all three, in different shares."""
    t = trades(spark, sf)
    tests = (("RT-2", 1.0, R.COSTS), ("RT-3", 0.5, R.SPREADS), ("RT-4", 0.25, R.SLIPPAGE))
    found = R.lower_bounds_of(t, ["run"], 20260915, {name: (F.col("cost_r") * share, multipliers) for name, share, multipliers in tests})
    return _bounded(found.select("run", "multiplier", "n", "expectancy_r", "low", "test"))


def rt11(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("rv_ratio"))
    return rounded(R.by_regime(trades(spark, sf), li), 6)


def rt12(spark, sf):
    return R.digest(trades(spark, sf), ["trade_id", "day", "side"])


def reconcile(spark, sf):
    """Orders as records of what was intended and done."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        k, F.when(k % 11 != 0, k.cast("string")).alias("opportunity_id"), (k % 13 != 0).alias("noticed"), (k % 7 != 0).alias("taken"), F.round(1 + (k % 5 - 2) / 15, 6).alias("intended_risk_r"), F.lit(1.2).alias("intended_entry"),
        F.round(1.2 + (k % 17) / 100_000, 6).alias("actual_entry"), F.lit(1.19).alias("intended_stop"), F.when(k % 19 == 0, 1.18).otherwise(1.19).alias("actual_stop"), F.lit(0.00135).alias("spread_at_fill"),
        F.when(k % 23 == 0, F.array(F.lit("late"))).when(k % 23 == 1, F.array().cast("array<string>")).alias("rule_violations"), F.round((k % 100) / 50 - 1, 6).alias("actual_r"), F.round((k % 100) / 50 - 1 + (k % 29) / 410, 6).alias("theoretical_r"))
    return V.reconcile(rows).select("o_orderkey", "cause")


def regime(spark, sf):
    b = bars(spark, sf)
    names = ["pre_london", "london", "new_york"]
    atr = FX.anchored(FX.session_days(b, names=names), FX.wilder_atr(b, ATR), "atr_bars", "atr", names).select("instrument", "day", "session", "atr")
    return rounded(V.regime_check(b, atr, rv_n=RV, gap_ns=RV_GAP))


def _open(spark, sf) -> DataFrame:
    """A trade open in each bar with two ticks or more, with a stop and a target near the bar's first price."""
    b = bars(spark, sf).where("tick_count > 1")
    long = F.expr("ts_utc_ns div 60000000000 % 2 = 0")
    up, down = F.round(F.col("bid_o") + 0.0004, 6), F.round(F.col("bid_o") - 0.0004, 6)
    return b.select(F.concat_ws(":", "instrument", "ts_utc_ns").alias("trade_id"), "instrument", F.when(long, "buy").otherwise("sell").alias("side"), F.when(long, down).otherwise(up).alias("stop"), F.when(long, up).otherwise(down).alias("target"), "ts_utc_ns")


def ambiguous(spark, sf):
    a = X.ambiguity(_open(spark, sf), bars(spark, sf))
    return a.select("trade_id", F.col("ambiguous").cast("long").alias("ambiguous"))


def resolved(spark, sf):
    return X.resolve(_open(spark, sf), ticks(spark, sf))


def excursions(spark, sf):
    """Trades of three hours from every bar on."""
    b = bars(spark, sf)
    t = b.select(F.concat_ws(":", "instrument", "ts_utc_ns").alias("trade_id"), "instrument", F.when(F.expr("ts_utc_ns div 60000000000 % 2 = 0"), "buy").otherwise("sell").alias("side"), F.col("ts_utc_ns").alias("entry_ns"), (F.col("ts_utc_ns") + 3 * T.HOUR).alias("exit_ns"), F.col("ask_c").alias("entry_price"), F.col("ask_c").alias("entry_reference"), (F.col("ask_c") - 0.01).alias("stop_reference"))
    return rounded(X.excursions(t, b), 6)


def reentry(spark, sf):
    """Breaks of each day's first mid, and whether they have been taken back 20 bars later."""
    b = FX.with_day(FX.with_mid(FX.wilder_atr(bars(spark, sf), ATR)))
    day = FX.W.partitionBy("instrument", "day").orderBy("rn")
    rows = b.withColumn("level", F.first("mid").over(day)).select("instrument", "day", "ts_utc_ns", "rn", "mid", "atr_bars", "level")
    return S.reentry_state(rows, "level", window=20).where("reentry_state is not null").select("instrument", "ts_utc_ns", F.col("reentry_state").cast("long").alias("reentry_state"))


QUERIES = {
    "SPEC_RT1_years": rt1, "SPEC_RT1_passed": rt1p, "SPEC_RT2_cost_stress": rt2, "SPEC_RT1_lower_bounds": rt1_bounds, "SPEC_RT2_to_RT4_lower_bounds": rt2_bounds, "SPEC_RT5_surface": rt5, "SPEC_RT7_without_best": rt7, "SPEC_RT8_pessimistic": rt8, "SPEC_RT9_placebo": rt9, "SPEC_RT10_random_timing": rt10,
    "SPEC_RT11_regimes": rt11, "SPEC_RT12_digest": rt12, "SPEC_reconciliation": reconcile, "SPEC_regime_check": regime, "SPEC_ambiguous_bars": ambiguous, "SPEC_resolved_bars": resolved, "SPEC_excursions": excursions, "SPEC_reentry_state": reentry,
}

def _mean_of(r: str, n: str = "count(*)") -> str:
    """A mean that doesn't depend on the order of its rows."""
    return f"CAST(sum(CAST(round(({r}) * 1e9) AS BIGINT)) AS DOUBLE) / 1e9 / {n}"


_MEAN = _mean_of("r")
_T = f"t AS (SELECT o_custkey % 20 AS run, o_orderkey AS trade_id, CAST(o_orderdate AS DATE) AS day, {_R} AS r, round(0.02 + (o_orderkey % 5) / 100, 6) AS cost FROM orders)"
_OPEN = """o AS (SELECT instrument || ':' || ts_utc_ns AS trade_id, instrument, ts_utc_ns, ts_utc_ns // 60000000000 % 2 = 0 AS long, round(bid_o + 0.0004, 6) AS up, round(bid_o - 0.0004, 6) AS down, bid_h, bid_l, ask_h, ask_l FROM bars WHERE tick_count > 1)"""
_YEARS = f"{_T}, y AS (SELECT run, year(day) AS year, count(*) AS n, {_MEAN} AS e, {_mean_of('r', '1')} AS total FROM t GROUP BY ALL), z AS (SELECT *, CASE WHEN sum(total) OVER (PARTITION BY run) > 0 THEN total / sum(total) OVER (PARTITION BY run) END AS share FROM y)"


_DRAW = "(('0x' || substr(md5('20260915:' || i.i || ':' || trade_id), 1, 13))::BIGINT / 4503599627370496.0)"
_TIMES = "(SELECT unnest(generate_series(1, 200)) AS i) i"
_BAND = f"""q AS (SELECT run, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.975) AS hi FROM d GROUP BY run), o AS (SELECT run, {_MEAN} AS e FROM t GROUP BY run)
      SELECT run, round(o.e, 6) + 0.0 AS expectancy_r, round(lo, 6) + 0.0 AS low, round(hi, 6) + 0.0 AS high, CAST(o.e < lo - 1e-9 OR o.e > hi + 1e-9 AS BIGINT) AS outside FROM o JOIN q USING (run)"""


_STEPS = list(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))


def _bounds(by: str, of: str, cost: str, multipliers: str) -> str:
    """CTEs up to bounded(by, m, n, e, low): the same draws from the same digests."""
    draws = ", ".join(f"CAST(('0x' || substr(d, {1 + 8 * k}, 8)) AS BIGINT) / 4294967296.0" for k in range(4))
    drawn = " + ".join(f"CAST(u >= {x!r} AS BIGINT)" for x in _STEPS)
    return f"""priced AS (SELECT *, CAST(round(r * 1e9) AS BIGINT) AS ru, CAST(round(({cost}) * 1e9) AS BIGINT) AS cu FROM {of}), four AS (
      SELECT {by}, ru, cu, f.f, md5('20260915:' || f.f || ':' || trade_id) AS d FROM priced, (SELECT unnest(generate_series(0, 249)) AS f) f), drawn AS (SELECT {by}, ru, cu, f, unnest([{draws}]) AS u, unnest([0, 1, 2, 3]) AS k FROM four), taken AS (
      SELECT *, {drawn} AS w FROM drawn), sums AS (SELECT {by}, f, k, sum(w) AS w, sum(w * ru) AS r, sum(w * cu) AS c FROM taken GROUP BY ALL), ms AS (SELECT unnest({multipliers})::DOUBLE AS m), means AS (
      SELECT {by}, m, CASE WHEN w > 0 THEN (CAST(r AS DOUBLE) - (m - 1) * CAST(c AS DOUBLE)) / 1e9 / w END AS v FROM sums, ms), lows AS (SELECT {by}, m, quantile_cont(v, 0.025) AS low FROM means GROUP BY ALL), bounded AS (
      SELECT * FROM (SELECT {by}, m, count(*) AS n, {_mean_of(f'r - (m - 1) * ({cost})')} AS e FROM {of}, ms GROUP BY ALL) JOIN lows USING ({by}, m))"""


def _spread(c: str, name: str) -> str:
    return f"round(quantile_cont({c}, 0.5), 8) AS median_{name}, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 8) + 0.0 AS iqr_{name}"


ORACLE_SQL = {
    "SPEC_RT1_years": f"WITH {_YEARS} SELECT run, year, n, round(e, 6) + 0.0 AS expectancy_r, round(total, 6) + 0.0 AS total_r, round(share, 6) + 0.0 AS of_total FROM z",
    "SPEC_RT1_passed": f"WITH {_YEARS}, g AS (SELECT run, count(*) FILTER (e > 0) / count(*) AS good, max(share) AS most FROM z GROUP BY run) SELECT run, round(good, 6) AS good_years, round(most, 6) + 0.0 AS most, CAST(good >= 0.7 AND coalesce(most <= 0.4, FALSE) AS BIGINT) AS passed FROM g",
    "SPEC_RT2_cost_stress": f"WITH {_T} SELECT run, m.m AS multiplier, count(*) AS n, round({_mean_of('r - (m.m - 1) * cost')}, 6) + 0.0 AS expectancy_r FROM t, (SELECT unnest([1.0, 1.5, 2.0, 3.0])::DOUBLE AS m) m GROUP BY ALL",
    "SPEC_RT5_surface": f"WITH {_T} SELECT run, CASE WHEN trade_id % 2 = 0 THEN 'buffer' ELSE 'length' END AS parameter, [-0.2, -0.1, 0.0, 0.1, 0.2][trade_id % 5 + 1]::DOUBLE AS value, count(*) AS n, round({_MEAN}, 6) + 0.0 AS expectancy_r FROM t GROUP BY ALL",
    "SPEC_RT7_without_best": f"WITH {_T}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY r DESC, trade_id) AS k, count(*) OVER (PARTITION BY run) AS n FROM t) SELECT run, s.s AS share, count(*) AS n, round({_MEAN}, 6) + 0.0 AS expectancy_r FROM k, (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS s) s WHERE k.k > ceil(round(k.n * s.s, 9)) GROUP BY ALL",
    "SPEC_RT8_pessimistic": f"WITH {_T}, g AS (SELECT run, avg(CAST(trade_id % 9 = 0 AS INT)) AS a, {_MEAN} AS e, {_mean_of('CASE WHEN trade_id % 9 = 0 THEN least(r, -1.0) ELSE r END')} AS p FROM t GROUP BY run) SELECT run, round(a, 6) AS ambiguous, round(e, 6) + 0.0 AS expectancy_r, round(p, 6) + 0.0 AS pessimistic_r, CAST(e - p < 0.2 * abs(e) AS BIGINT) AS passed FROM g",
    "SPEC_RT9_placebo": f"""WITH {_T}, x AS (SELECT run, i.i, CASE WHEN {_DRAW} < 0.5 THEN r ELSE -r - 0.1 END AS r FROM t, {_TIMES}), d AS (SELECT run, i, {_MEAN} AS e FROM x GROUP BY ALL), {_BAND}""",
    "SPEC_RT10_random_timing": f"""WITH {BARS}, b AS (SELECT instrument AS run, {day_of('ts_utc_ns')} AS day, ts_utc_ns, bid_c, ask_c FROM bars), w AS (
      SELECT *, row_number() OVER d - 1 AS slot, count(*) OVER (PARTITION BY run, day) - 1 AS n, last(bid_c) OVER e AS out_bid, last(ask_c) OVER e AS out_ask FROM b
      WINDOW d AS (PARTITION BY run, day ORDER BY ts_utc_ns), e AS (PARTITION BY run, day ORDER BY ts_utc_ns ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), s AS (
      SELECT run, day, slot, n, run || '/' || day AS trade_id, round(CASE WHEN day(day) % 2 = 0 THEN out_bid - ask_c ELSE bid_c - out_ask END / {_RISK}, 6) AS r FROM w WHERE slot < n), t AS (SELECT * FROM s WHERE slot = n // 3),
      x AS (SELECT t.run, t.day, i.i, CAST(floor({_DRAW} * t.n) AS BIGINT) AS slot FROM t, {_TIMES}), d AS (SELECT x.run, x.i, {_MEAN} AS e FROM x JOIN s USING (run, day, slot) GROUP BY ALL), {_BAND}""",
    "SPEC_RT1_lower_bounds": f"WITH {_T}, y AS (SELECT *, year(day) AS year FROM t), {_bounds('run, year', 'y', '0.0', '[1.0]')} SELECT run, year, n, round(e, 6) + 0.0 AS expectancy_r, round(low, 9) + 0.0 AS low FROM bounded",
    "SPEC_RT2_to_RT4_lower_bounds": " UNION ALL ".join(
        f"(WITH {_T}, {_bounds('run', 't', f'cost * {share}', str(list(multipliers)))} SELECT run, m AS multiplier, n, round(e, 6) + 0.0 AS expectancy_r, round(low, 9) + 0.0 AS low, '{test}' AS test FROM bounded)"
        for test, share, multipliers in (("RT-2", 1.0, R.COSTS), ("RT-3", 0.5, R.SPREADS), ("RT-4", 0.25, R.SLIPPAGE))),
    "SPEC_RT11_regimes": f"WITH {_T}, d AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS v FROM lineitem GROUP BY 1), c AS (SELECT quantile_cont(v, 1 / 3) AS a, quantile_cont(v, 2 / 3) AS b FROM d) SELECT run, CAST(v > a AS BIGINT) + CAST(v > b AS BIGINT) AS regime, count(*) AS n, round({_MEAN}, 6) + 0.0 AS expectancy_r FROM t JOIN d USING (day), c GROUP BY ALL",
    "SPEC_RT12_digest": f"WITH {_T} SELECT run, count(*) AS n, sha256(string_agg(sha256(trade_id || '|' || day || '|' || CASE WHEN trade_id % 2 = 0 THEN 'buy' ELSE 'sell' END), '' ORDER BY trade_id)) AS result_sha256 FROM t GROUP BY run",
    "SPEC_reconciliation": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'strategy' WHEN o_orderkey % 13 = 0 OR o_orderkey % 7 = 0 THEN 'behavioural' WHEN abs(round(1 + (o_orderkey % 5 - 2) / 15, 6) - 1) > 0.1 THEN 'risk' WHEN o_orderkey % 17 > 13 THEN 'execution' WHEN o_orderkey % 19 = 0 THEN 'risk'
      WHEN o_orderkey % 23 = 0 THEN 'behavioural' WHEN o_orderkey % 29 > 20 THEN 'execution' ELSE 'variance' END AS cause FROM orders""",
    "SPEC_regime_check": f"""WITH {BARS}, {WINDOWS}, {atr_sql(ATR)}, {ANCHOR_SQL}, {_rv(RV)}, r AS (SELECT instrument, year(day) AS year, session, count(*) AS n_days, {_spread('range', 'range')}, {_spread('range / nullif(atr, 0)', 'ratio')} FROM anchored WHERE n_bars > 0 AND observed GROUP BY ALL), v AS (
      SELECT b.instrument, year(w.day) AS year, w.session, {_spread('rv.rv', 'rv')}, round(quantile_cont(b.spread_twa, 0.5), 8) AS median_spread FROM bars b JOIN rv USING (instrument, ts_utc_ns) JOIN windows w ON w.instrument = b.instrument AND w.day = {day_of('b.ts_utc_ns')} AND b.ts_utc_ns >= w.start_ns AND b.ts_utc_ns < w.end_ns WHERE w.session IN ('pre_london', 'london', 'new_york') GROUP BY ALL)
      SELECT * FROM r LEFT JOIN v USING (instrument, year, session)""",
    "SPEC_ambiguous_bars": f"WITH {BARS}, {_OPEN} SELECT trade_id, CAST(CASE WHEN long THEN bid_l <= down AND bid_h >= up ELSE ask_h >= up AND ask_l <= down END AS BIGINT) AS ambiguous FROM o",
    "SPEC_resolved_bars": f"""WITH {BARS}, {_OPEN}, x AS (SELECT o.trade_id, t.ts_utc_ns AS tick_ns, t.row_sequence, CASE WHEN CASE WHEN long THEN t.bid <= down ELSE t.ask >= up END THEN 'stop' WHEN CASE WHEN long THEN t.bid > up ELSE t.ask < down END THEN 'target' END AS what
      FROM o JOIN ticks t ON t.instrument = o.instrument AND t.ts_utc_ns - t.ts_utc_ns % 60000000000 = o.ts_utc_ns) SELECT trade_id, first(what ORDER BY tick_ns, row_sequence) FILTER (what IS NOT NULL) AS outcome, 'tick' AS resolved_by FROM x GROUP BY trade_id""",
    "SPEC_excursions": f"""WITH {BARS} SELECT a.instrument || ':' || a.ts_utc_ns AS trade_id, round(min(CASE WHEN a.ts_utc_ns // 60000000000 % 2 = 0 THEN b.bid_l - a.ask_c ELSE a.ask_c - b.ask_h END / abs(a.ask_c - (a.ask_c - 0.01))), 6) + 0.0 AS mae_r, round(max(CASE WHEN a.ts_utc_ns // 60000000000 % 2 = 0 THEN b.bid_h - a.ask_c ELSE a.ask_c - b.ask_l END / abs(a.ask_c - (a.ask_c - 0.01))), 6) + 0.0 AS mfe_r
      FROM bars a JOIN bars b ON a.instrument = b.instrument AND b.ts_utc_ns >= a.ts_utc_ns AND b.ts_utc_ns <= a.ts_utc_ns + 10800000000000 GROUP BY 1""",
    "SPEC_reentry_state": f"""WITH {BARS}, {atr_sql(ATR)}, d AS (SELECT b.instrument, b.ts_utc_ns, b.rn, b.mid, a.atr_bars, {day_of('b.ts_utc_ns')} AS day FROM bars b JOIN atr a USING (instrument, ts_utc_ns)), l AS (SELECT *, first(mid) OVER (PARTITION BY instrument, day ORDER BY rn) AS level FROM d),
      k AS (SELECT *, coalesce(mid - level > 0.1 * atr_bars, FALSE) AS beyond FROM l), f AS (SELECT * FROM k WHERE beyond QUALIFY row_number() OVER (PARTITION BY instrument, day ORDER BY rn) = 1)
      SELECT n.instrument, n.ts_utc_ns, CAST((SELECT bool_or(x.mid <= f.level) FROM k x WHERE x.instrument = f.instrument AND x.rn BETWEEN f.rn + 1 AND f.rn + 20) AS BIGINT) AS reentry_state FROM f JOIN k n ON n.instrument = f.instrument AND n.rn = f.rn + 20""",
}

"""Strategy scans, exits of positions, slippage, selected quantiles and split intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators import describe as D
from tidemark.operators import execution as X
from tidemark.operators import positions as PO
from tidemark.operators import scan as SC
from tidemark.operators import study as S
from tidemark.operators.bars import with_gaps

from tidemark.operators.resampling import split_bootstrap
from tidemark.operators.selection import selected_quantiles
from tidemark.queries.base import BARS, TICKS, bars, day_of, local, rounded, table, ticks
from tidemark.queries.spec import _ORDERS, _orders

SCAN = {"least_bars": 3.0, "buffer": 0.0001}
SEED, RESAMPLES = 20260916, 500
PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def prepared(b):
    """Bars that carry in the range of the day before."""
    return S.previous_days(b).withColumn("prev_range", F.col("prev_day_high") - F.col("prev_day_low"))


def signals(rows):
    return SC.scan_days(rows, SC.break_of_day, SCAN, features=("prev_range",))


def scan(spark, sf):
    c = signals(prepared(bars(spark, sf)))
    return rounded(c.select("instrument", F.col("day").cast("string").alias("day"), "ts_utc_ns", "direction", "entry_reference", "stop_reference", F.col("levels")["broken"].alias("broken"), "note"))


def replayed(spark, sf):
    """Signals before three cuts that differ without the bars after them, beside all signals before each: none may."""
    b = bars(spark, sf)
    cuts = SC.cut_points(b)
    every = signals(prepared(b)).select("instrument", "ts_utc_ns").withColumn("cut_ns", F.explode(F.array(*(F.lit(c).cast("long") for c in cuts)))).where("ts_utc_ns < cut_ns").groupBy("cut_ns").agg(F.count(F.lit(1)).alias("n_signals"))
    leaks = SC.replay(b, prepared, signals, cuts).groupBy("cut_ns").agg(F.count(F.lit(1)).alias("n"))
    return every.join(leaks, "cut_ns", "left").select("cut_ns", "n_signals", F.coalesce("n", F.lit(0)).cast("long").alias("n_leaks"))


def _positions(spark, sf):
    """Every third tick opens a position at its price, for up to 40 hours, with levels at five distances."""
    t = ticks(spark, sf).where("row_sequence % 3 = 0")
    buy = F.expr("row_sequence % 2 = 0")
    entry = F.when(buy, F.col("ask")).otherwise(F.col("bid"))
    away = F.element_at(F.array(*map(F.lit, (0.0004, 0.001, 0.002, 0.004, 0.01))), F.expr("cast(row_sequence % 5 + 1 as int)"))
    risk, gain = F.when(buy, -away).otherwise(away), F.when(buy, 1.5 * away).otherwise(-1.5 * away)
    return t.select(F.col("row_sequence").cast("string").alias("position_id"), "instrument", F.when(buy, "buy").otherwise("sell").alias("side"), F.col("ts_utc_ns").alias("entry_ns"), F.round(entry + risk, 6).alias("stop"), F.round(entry + gain, 6).alias("target"), (F.col("ts_utc_ns") + 40 * T.HOUR).alias("until_ns"), F.lit(0.00002).alias("slip"), entry.alias("entry_price"))


def _exits(spark, sf):
    t = ticks(spark, sf)
    p = _positions(spark, sf)
    return p, PO.exits(p.drop("entry_price"), with_gaps(bars(spark, sf).drop("prev_gap_ns"), continuous=True), t)


def exits(spark, sf):
    e = _exits(spark, sf)[1]
    return rounded(e.select("position_id", "exit_ns", "exit_price", "outcome", F.col("gap_exit").cast("long").alias("gap_exit")))


def exit_results(spark, sf):
    """What the exits are worth, by outcome: those after a gap lose more than was risked."""
    p, e = _exits(spark, sf)
    both = p.withColumnsRenamed({"stop": "stop_reference"}).withColumn("entry_reference", F.col("entry_price")).join(e.where("outcome is not null"), "position_id")
    r = X.r_multiples(both)
    return rounded(r.groupBy("outcome", F.col("gap_exit").cast("long").alias("gap_exit")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r_net"), 6).alias("r_net"), F.round(F.min("r_net"), 6).alias("worst_r"), F.count_if(F.col("r_net") < -1).alias("beyond_risk")))


def slippage(spark, sf):
    """Slippage of every order, by its bar's spread."""
    b = bars(spark, sf).select("instrument", F.col("ts_utc_ns").alias("minute"), "spread_twa")
    o = _orders(spark, sf).drop("slip").withColumn("minute", F.expr(T.minute_start("from_ns"))).join(b, ["instrument", "minute"])
    return rounded(X.slippage(o, SEED).select("order_id", "kind", "slip"), 9)


def fitted(spark, sf):
    """The stops' factor, from how far ticks jump beyond the levels that they trigger."""
    o = _orders(spark, sf).where("kind = 'stop'").withColumn("slip", F.lit(0.0))
    b = bars(spark, sf).select("instrument", F.col("ts_utc_ns").alias("minute"), "spread_twa")
    f = X.fills(o, ticks(spark, sf)).where("fill_ns is not null").join(o.select("order_id", "instrument", "side", "level"), "order_id").withColumn("minute", F.expr(T.minute_start("fill_ns")))
    jump = F.when(F.col("side") == "buy", F.col("fill_price") - F.col("level")).otherwise(F.col("level") - F.col("fill_price"))
    return rounded(X.fit_slippage(f.join(b, ["instrument", "minute"]).withColumn("jump", jump), ["instrument"]), 6)


def selected(spark, sf):
    """Quantiles of prices, each group's by selection."""
    q = selected_quantiles(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", PROBS)
    return rounded(q.select("l_returnflag", "l_linestatus", "n", F.posexplode("q").alias("k", "q")).select("l_returnflag", "l_linestatus", "n", F.col("k").cast("long").alias("k"), "q"), 6)


def r5_split(spark, sf):
    """R5's intervals by hour of the week and by year, with draws that many tasks share."""
    rows = D.hour_of_week(bars(spark, sf))
    hours = split_bootstrap(rows, ["instrument", "weekday", "hour"], "spread_twa", F.lit(SEED) + F.col("weekday") * 100 + F.col("hour"), RESAMPLES)
    years = split_bootstrap(rows, ["instrument", "year"], "spread_twa", F.lit(SEED + 20_000) + F.col("year"), RESAMPLES)
    return rounded(hours.unionByName(years, allowMissingColumns=True))


def trade_split(spark, sf):
    """Medians of trades' results by customers' segment with split intervals: groups of thousands."""
    o = table(spark, sf, "orders").select(F.expr("o_custkey % 5").alias("run"), F.round(F.col("o_totalprice") / 1000, 6).alias("v"))
    return rounded(split_bootstrap(o, ["run"], "v", F.lit(SEED) + F.col("run"), RESAMPLES, task_draws=1 << 20), 6)


QUERIES = {
    "U4_strategy_scan": scan, "U4_prefix_replay": replayed, "SPEC_exits": exits, "SPEC_exit_results": exit_results, "SPEC_slippage_draws": slippage, "SPEC_slippage_fit": fitted, "OP68_selected_quantiles": selected,
    "OP71_R5_split_intervals": r5_split, "OP70_split_intervals": trade_split,
}

_SCAN = f"""d AS (SELECT instrument, ts_utc_ns, {day_of('ts_utc_ns')} AS day, mid, bid_c, ask_c FROM bars), r AS (SELECT instrument, day, lag(max(mid) - min(mid)) OVER (PARTITION BY instrument ORDER BY day) AS prev_range FROM d GROUP BY instrument, day),
  s AS (SELECT d.*, r.prev_range, row_number() OVER o - 1 AS i, max(mid) OVER e AS high, min(mid) OVER e AS low FROM d JOIN r USING (instrument, day) WINDOW o AS (PARTITION BY instrument, day ORDER BY ts_utc_ns), e AS (PARTITION BY instrument, day ORDER BY ts_utc_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  c AS (SELECT *, mid > high + {SCAN['buffer']} AS up FROM s WHERE i >= {int(SCAN['least_bars'])} AND high - low <= prev_range AND (mid > high + {SCAN['buffer']} OR mid < low - {SCAN['buffer']}))"""
_POSITIONS = """p0 AS (SELECT *, row_sequence % 2 = 0 AS buy, CASE WHEN row_sequence % 2 = 0 THEN ask ELSE bid END AS entry, [0.0004, 0.001, 0.002, 0.004, 0.01][row_sequence % 5 + 1]::DOUBLE AS away FROM ticks WHERE row_sequence % 3 = 0),
  p AS (SELECT row_sequence AS id, instrument, buy, ts_utc_ns AS entry_ns, ts_utc_ns + 144000000000000 AS until_ns, entry, round(entry + CASE WHEN buy THEN -away ELSE away END, 6) AS stop, round(entry + CASE WHEN buy THEN 1.5 * away ELSE -1.5 * away END, 6) AS target FROM p0),
  tt AS (SELECT *, ts_utc_ns - lag(ts_utc_ns) OVER (PARTITION BY instrument ORDER BY ts_utc_ns, row_sequence) > 60000000000 AS gap FROM ticks),
  met AS (SELECT p.*, t.ts_utc_ns AS tick_ns, t.row_sequence, coalesce(t.gap, FALSE) AS gap, CASE WHEN p.buy THEN t.bid ELSE t.ask END AS price FROM p JOIN tt t ON t.instrument = p.instrument AND t.ts_utc_ns > p.entry_ns),
  w AS (SELECT *, CASE WHEN tick_ns >= until_ns THEN 'time' WHEN CASE WHEN buy THEN price <= stop ELSE price >= stop END THEN 'stop' WHEN CASE WHEN buy THEN price > target ELSE price < target END THEN 'target' END AS what FROM met),
  x AS (SELECT * FROM w WHERE what IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY tick_ns, row_sequence) = 1),
  f AS (SELECT *, CASE WHEN what = 'target' THEN target ELSE CASE WHEN what = 'time' THEN price WHEN buy THEN least(stop, price) ELSE greatest(stop, price) END + CASE WHEN buy THEN -1 ELSE 1 END * 0.00002 * CASE WHEN gap THEN 3.0 ELSE 1.0 END END AS fill FROM x)"""
_PRICED = "o AS (SELECT p.order_id, p.instrument, p.kind, b.spread_twa, ('0x' || substr(md5('{seed}:' || p.order_id || ':' || p.kind), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM placed p JOIN bars b ON b.instrument = p.instrument AND b.ts_utc_ns = p.from_ns - p.from_ns % 60000000000)"


def _mix(x: str) -> str:
    """The 32-bit mixing of draws, as an expression of a BIGINT column of a subquery."""
    a = f"xor({x}, {x} >> 16)"
    b = f"(({a})::HUGEINT * 2246822507 & 4294967295)::BIGINT"
    c = f"xor({b}, {b} >> 13)"
    d = f"(({c})::HUGEINT * 3266489909 & 4294967295)::BIGINT"
    return f"xor({d}, {d} >> 16)"


def _split(rows: str, keys: str, value: str, seed: str, name: str) -> str:
    """CTEs up to name(keys, n, median, ci_low, ci_high) of rows."""
    stages = [("own", "(seed & 4294967295)", "s"), ("keyed", "((s + b) & 4294967295)", "o")]
    p = name
    return f"""{p}_v AS (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS rank FROM {rows} WHERE {value} IS NOT NULL), {p}_n AS (SELECT {keys}, count(*) AS n, ({seed})::BIGINT AS seed FROM {p}_v GROUP BY {keys}),
  {p}_s AS (SELECT *, {_mix(stages[0][1])} AS s FROM {p}_n), {p}_b AS (SELECT *, unnest(generate_series(0, {RESAMPLES - 1})) AS b FROM {p}_s WHERE n >= 10), {p}_o AS (SELECT *, {_mix(stages[1][1])} AS o FROM {p}_b),
  {p}_i AS (SELECT {keys}, n, b, o, unnest(range(n)) AS i FROM {p}_o), {p}_m AS (SELECT *, xor({_mix('xor(i, o)')}, o >> 1) AS m FROM {p}_i), {p}_r AS (SELECT {keys}, n, b, ({_mix('m')} * n) >> 32 AS rank FROM {p}_m),
  {p}_d AS (SELECT r.*, v.v FROM {p}_r r JOIN {p}_v v USING ({keys}, rank)), {p}_e AS (SELECT {keys}, b, median(v) AS m FROM {p}_d GROUP BY {keys}, b), {p}_q AS (SELECT {keys}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM {p}_e GROUP BY {keys}),
  {p}_k AS (SELECT {keys}, count(*) AS n, median(v) AS median FROM {p}_v GROUP BY {keys}), {p} AS (SELECT {keys}, n, median, lo AS ci_low, hi AS ci_high FROM {p}_k LEFT JOIN {p}_q USING ({keys}))"""


_HALF = X.half_normal("u")
ORACLE_SQL = {
    "U4_strategy_scan": f"WITH {BARS}, {_SCAN} SELECT instrument, CAST(day AS VARCHAR) AS day, ts_utc_ns, CASE WHEN up THEN 'long' ELSE 'short' END AS direction, round(CASE WHEN up THEN ask_c ELSE bid_c END, 8) AS entry_reference, round(CASE WHEN up THEN low ELSE high END, 8) AS stop_reference, round(CASE WHEN up THEN high ELSE low END, 8) AS broken, CASE WHEN up THEN 'above' ELSE 'below' END AS note FROM c",
    "U4_prefix_replay": f"WITH {BARS}, {_SCAN}, e AS (SELECT min(ts_utc_ns) AS lo, max(ts_utc_ns) AS hi FROM bars), k AS (SELECT lo + (hi - lo) * k.k // 4 + 60000000000 AS cut_ns FROM e, (SELECT unnest([1, 2, 3]) AS k) k) SELECT cut_ns, count(*) AS n_signals, 0::BIGINT AS n_leaks FROM c JOIN k ON c.ts_utc_ns < k.cut_ns GROUP BY cut_ns",
    "SPEC_exits": f"WITH {TICKS}, {_POSITIONS} SELECT CAST(p.id AS VARCHAR) AS position_id, f.tick_ns AS exit_ns, round(f.fill, 8) AS exit_price, f.what AS outcome, CAST(f.gap AS BIGINT) AS gap_exit FROM p LEFT JOIN f USING (id)",
    "SPEC_exit_results": f"WITH {TICKS}, {_POSITIONS}, r AS (SELECT what, gap, CASE WHEN buy THEN fill - entry ELSE entry - fill END / abs(entry - stop) AS r FROM f) SELECT what AS outcome, CAST(gap AS BIGINT) AS gap_exit, count(*) AS n, round(avg(r), 6) + 0.0 AS r_net, round(min(r), 6) + 0.0 AS worst_r, count(*) FILTER (r < -1) AS beyond_risk FROM r GROUP BY ALL",
    "SPEC_slippage_draws": f"WITH {BARS}, {_ORDERS}, {_PRICED.format(seed=SEED)} SELECT order_id, kind, round(CASE kind WHEN 'market' THEN 0.25 WHEN 'stop' THEN 0.5 ELSE 0.0 END * spread_twa * {_HALF}, 9) + 0.0 AS slip FROM o",
    "SPEC_slippage_fit": f"""WITH {BARS}, {_ORDERS}, j AS (SELECT p.instrument, p.s * (CASE WHEN p.s = 1 THEN greatest(p.level, h.price) ELSE least(p.level, h.price) END - p.level) / b.spread_twa AS x FROM hit h JOIN placed p USING (order_id) JOIN bars b ON b.instrument = p.instrument AND b.ts_utc_ns = h.ts_utc_ns - h.ts_utc_ns % 60000000000 WHERE p.kind = 'stop' AND b.spread_twa > 0),
      g AS (SELECT unnest(range(1, 20)) / 20.0 AS u), z AS (SELECT u, {_HALF} AS z FROM g), q AS (SELECT j.instrument, z.u, any_value(z.z) AS z, count(*) AS n, list(x ORDER BY x) AS xs FROM j, z GROUP BY j.instrument, z.u), i AS (SELECT *, (n - 1) * u AS pos FROM q),
      v AS (SELECT *, xs[floor(pos)::INT + 1] + (pos - floor(pos)) * (xs[ceil(pos)::INT + 1] - xs[floor(pos)::INT + 1]) AS v FROM i) SELECT instrument, any_value(n) AS n, round(sum(v * z) / sum(z * z), 6) + 0.0 AS k FROM v GROUP BY instrument""",
    "OP68_selected_quantiles": "WITH p AS (SELECT unnest(" + str(PROBS) + f")::DOUBLE AS p, unnest(range({len(PROBS)})) AS k), l AS (SELECT l_returnflag, l_linestatus, count(*) AS n, list(l_extendedprice ORDER BY l_extendedprice) AS xs FROM lineitem GROUP BY ALL), i AS (SELECT *, (n - 1) * p AS pos FROM l, p) SELECT l_returnflag, l_linestatus, n, k, round(xs[floor(pos)::INT + 1] + (pos - floor(pos)) * (xs[ceil(pos)::INT + 1] - xs[floor(pos)::INT + 1]), 6) AS q FROM i",
    "OP71_R5_split_intervals": f"""WITH {BARS}, rows_x AS (SELECT instrument, isodow({local('ts_utc_ns', 'Europe/London')}) AS weekday, hour({local('ts_utc_ns', 'Europe/London')}) AS hour, year(make_timestamp(ts_utc_ns // 1000)) AS year, spread_twa FROM bars), {_split('rows_x', 'instrument, weekday, hour', 'spread_twa', f'{SEED} + weekday * 100 + hour', 'h')},
      {_split('rows_x', 'instrument, year', 'spread_twa', f'{SEED + 20_000} + year', 'y')}, a AS (SELECT instrument, weekday, hour, n, median, ci_low, ci_high, NULL::BIGINT AS year FROM h UNION ALL SELECT instrument, NULL, NULL, n, median, ci_low, ci_high, year FROM y)
      SELECT instrument, weekday, hour, n, round(median, 8) AS median, round(ci_low, 8) AS ci_low, round(ci_high, 8) AS ci_high, year FROM a""",
    "OP70_split_intervals": f"WITH rows_x AS (SELECT o_custkey % 5 AS run, round(o_totalprice / 1000, 6) AS v FROM orders), {_split('rows_x', 'run', 'v', f'{SEED} + run', 'g')} SELECT run, n, round(median, 6) AS median, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM g",
}

"""Reports, events and the gate. The driver's ticks cover one month; reports by year also run on daily ranges of lineitem (1995 to 2001)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators import describe as D
from tidemark.operators import events as E
from tidemark.queries.base import BARS, WINDOWS, atr_sql, bars, local, rounded, table
from tidemark.queries.market import ANCHOR_SQL, ATR, PCT, PCT_SQL

P = E.Params(atr_n=ATR, pct_n=PCT)


def daily(spark, sf) -> DataFrame:
    """Days of lineitem as session days: a return flag is an instrument, the day's prices its range, its quantities the ATR."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("instrument"), F.to_date("l_shipdate").alias("day")).agg((F.max("l_extendedprice") - F.min("l_extendedprice")).alias("range"), F.max("l_quantity").alias("atr"))
    return li.select("instrument", "day", F.lit("london").alias("session"), "range", "atr", F.try_divide("range", F.nullif("atr", F.lit(0.0))).alias("ratio"))


def op64(spark, sf):
    return rounded(D.r5_by_hour(bars(spark, sf)))


def op65(spark, sf):
    return rounded(D.r5_by_year(bars(spark, sf)))


def op66(spark, sf):
    return rounded(D.r1_marginals(D.session_ratios(bars(spark, sf), ATR)))


def op66y(spark, sf):
    return rounded(D.r1_marginals(daily(spark, sf)), 6)


def op67(spark, sf):
    return rounded(D.r2_buckets(D.r2_days(bars(spark, sf), ATR, PCT)))


def op67y(spark, sf):
    days = daily(spark, sf).select("instrument", "day", "ratio", (F.floor(F.col("range") / 20000) / 10).alias("pct"))
    return rounded(D.r2_buckets(D.quintiles(days, "pct", ["instrument"], few=True)), 6)


def op70(spark, sf):
    return rounded(D.grouped_bootstrap(daily(spark, sf).withColumn("weekday", F.weekday("day")), ["instrument", "weekday"], "ratio", F.lit(20260914) + F.col("weekday")))


def op71(spark, sf):
    return rounded(D.r5_intervals(bars(spark, sf)).unionByName(D.r5_year_intervals(bars(spark, sf)), allowMissingColumns=True))


def op71r1(spark, sf):
    """Intervals of the session ranges, by year and weekday."""
    return rounded(D.r1_intervals(D.session_ratios(bars(spark, sf), ATR)))


def op71r2(spark, sf):
    """Intervals of London's range by the morning's bucket."""
    return rounded(D.r2_intervals(D.r2_days(bars(spark, sf), ATR, PCT)))


def op72(spark, sf):
    return rounded(D.box_stats(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice"), 6)


def op87(spark, sf):
    q = D.quintiles(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"], few=True)
    return rounded(q.groupBy("l_returnflag", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")))


def op87b(spark, sf):
    """Quintiles of prices, of which nearly every row has another."""
    q = D.quintiles(table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus"])
    return rounded(q.groupBy("o_orderstatus", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")))


def _events(spark, sf):
    return E.detect(bars(spark, sf), P)


def op134(spark, sf):
    d = E.morning_days(bars(spark, sf), P)
    return rounded(d.select("instrument", F.col("day").cast("string").alias("day"), "high", "low", "pct", F.col("excluded").cast("long").alias("excluded")))


def op135(spark, sf):
    e = _events(spark, sf)
    return e.select("instrument", "context", F.col("trading_day").cast("string").alias("day"), "direction", "ts_utc_ns")


def op138(spark, sf):
    return E.eligible_days(bars(spark, sf), P).select("instrument", F.col("day").cast("string").alias("day"))


def _years(spark, sf):
    return bars(spark, sf).select("instrument", F.expr(T.utc_year("ts_utc_ns")).alias("year")).distinct()


def op73(spark, sf):
    return rounded(E.counts_by_year(_events(spark, sf), _years(spark, sf)))


def op74(spark, sf):
    """The weekdays of each year that has orders, beside the days that have any."""
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).where(F.weekday("day") < 5)
    return rounded(E.weekdays_in(o.groupBy(F.year("day").alias("year")).agg(F.count_distinct("day").alias("days"))))


def op139(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("instrument"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_orderkey")
    bad = o.where("o_orderkey % 12001 = 0").select("instrument", "year", F.lit("ERROR").alias("severity"), F.lit(1).alias("count"))
    a = E.admissible_years(o.select("instrument", "year", "month"), bad)
    return rounded(a.withColumn("admissible", F.col("admissible").cast("long")))


def _gate_input(spark, sf):
    """Orders by priority, half-year (for a year) and status stand for counts of contexts."""
    o = table(spark, sf, "orders")
    kind = F.element_at(F.create_map(F.lit("O"), F.lit("C-A∩C-B"), F.lit("F"), F.lit("C-A∩C-C"), F.lit("P"), F.lit("C-D∩C-B")), F.col("o_orderstatus"))
    return o.groupBy(F.col("o_orderpriority").alias("instrument"), (2 * F.year("o_orderdate") + (F.month("o_orderdate") > 6).cast("int")).alias("year"), kind.alias("context")).agg(F.count(F.lit(1)).alias("n"))


def op140(spark, sf):
    c = _gate_input(spark, sf)
    return rounded(E.gate(c, c.select("instrument", "year").distinct().withColumn("admissible", F.lit(True))))


QUERIES = {
    "OP64_hour_of_week_report": op64, "OP65_spread_by_year": op65, "OP66_session_ranges": op66, "OP66_ranges_by_year": op66y, "OP67_quiet_mornings": op67, "OP67_buckets_by_year": op67y, "OP70_bootstrap": op70, "OP71_seeded_intervals": op71, "OP71_session_intervals": op71r1, "OP71_morning_intervals": op71r2,
    "OP72_box_stats": op72, "OP73_context_counts": op73, "OP74_weekdays_by_year": op74, "OP87_quintiles": op87, "OP87_quintiles_of_prices": op87b, "OP134_morning_days": op134, "OP135_events": op135, "OP138_eligible_days": op138, "OP139_admissible_years": op139, "OP140_gate": op140,
}


def _q(value: str, name: str, digits: int = 8) -> str:
    return ", ".join(f"round(quantile_cont({value}, {q}), {digits}) AS {p}_{name}" for p, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))


_RATIOS = f"WITH {BARS}, {WINDOWS}, {atr_sql(ATR)}, {ANCHOR_SQL}, ratios AS (SELECT instrument, day, session, range, atr, range / nullif(atr, 0) AS ratio FROM anchored WHERE n_bars > 0 AND observed AND range / nullif(atr, 0) IS NOT NULL)"
_MARGINALS = "SELECT instrument, session, 'year' AS grouping, year(day) AS key, count(*) AS n, {q} FROM ratios GROUP BY ALL UNION ALL SELECT instrument, session, 'weekday', isodow(day) - 1, count(*), {q} FROM ratios GROUP BY ALL"
_DAILY = "ratios AS (SELECT l_returnflag AS instrument, CAST(l_shipdate AS DATE) AS day, 'london' AS session, max(l_extendedprice) - min(l_extendedprice) AS range, max(l_quantity) AS atr, (max(l_extendedprice) - min(l_extendedprice)) / nullif(max(l_quantity), 0) AS ratio FROM lineitem GROUP BY ALL)"


def _fold(source: str, value: str, key: str) -> str:
    """Recursive CTEs: folded({key}, v, b) from the rows of source."""
    return f"""vals AS (SELECT {key}, {value} AS v, count(*) AS c, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS k, sum(count(*)) OVER (PARTITION BY {key}) AS total FROM {source} GROUP BY {key}, {value}), folded AS (
      SELECT {key}, v, k, 0 AS b, CAST(c AS BIGINT) AS cnt FROM vals WHERE k = 1 UNION ALL
      SELECT n.{key}, n.v, n.k, CASE WHEN f.b < 4 AND f.cnt >= n.total / 5.0 THEN f.b + 1 ELSE f.b END, CAST(n.c + CASE WHEN f.b < 4 AND f.cnt >= n.total / 5.0 THEN 0 ELSE f.cnt END AS BIGINT) FROM folded f JOIN vals n ON n.{key} = f.{key} AND n.k = f.k + 1)"""


def _buckets(digits: int) -> str:
    return f"""each AS (SELECT instrument, CAST(NULL AS BIGINT) AS year, bucket, pct, ratio FROM named UNION ALL SELECT instrument, year(day), bucket, pct, ratio FROM named), spine5 AS (SELECT DISTINCT instrument, year, unnest([0, 1, 2, 3, 4]) AS bucket FROM each)
      SELECT s.instrument, s.year, s.bucket, count(e.ratio) AS n, round(min(e.pct), {digits}) AS pct_min, round(max(e.pct), {digits}) AS pct_max, {_q('e.ratio', 'ratio', digits)}
      FROM spine5 s LEFT JOIN each e ON e.instrument = s.instrument AND e.year IS NOT DISTINCT FROM s.year AND e.bucket = s.bucket GROUP BY s.instrument, s.year, s.bucket"""


_MORNING = f"""{BARS}, {WINDOWS}, {PCT_SQL}, {atr_sql(ATR)}, mornings AS (SELECT m.instrument, m.day, CASE WHEN m.observed THEN m.high END AS high, CASE WHEN m.observed THEN m.low END AS low, p.pct, m.end_ns AS morning_end, o.start_ns AS os, o.end_ns AS oe, m.partial OR o.partial AS excluded
    FROM days m JOIN days o USING (instrument, day) LEFT JOIN pct p USING (instrument, day) WHERE m.session = 'pre_london' AND o.session = 'london_open_window'), full_rows AS (SELECT b.instrument, b.ts_utc_ns, b.rn, b.mid, a.atr_bars, {{day}} AS day FROM bars b JOIN atr a USING (instrument, ts_utc_ns))"""
from tidemark.queries.base import day_of  # noqa: E402

_MORNING = _MORNING.replace("{day}", day_of("b.ts_utc_ns"))
_EVENTS = f"""{_MORNING}, opening AS (SELECT r.*, m.high, m.low FROM full_rows r JOIN mornings m USING (instrument, day) WHERE NOT m.excluded AND m.high IS NOT NULL AND r.ts_utc_ns >= m.os AND r.ts_utc_ns < m.oe AND r.atr_bars IS NOT NULL), crossed AS (
  SELECT *, 'long' AS direction FROM opening WHERE mid > high + 0.1 * atr_bars UNION ALL SELECT *, 'short' FROM opening WHERE mid < low - 0.1 * atr_bars), breaks AS (
  SELECT * FROM crossed QUALIFY row_number() OVER (PARTITION BY instrument, day, direction ORDER BY ts_utc_ns) = 1), found AS (
  SELECT instrument, 'C-A' AS context, day, 'none' AS direction, morning_end AS ts_utc_ns FROM mornings WHERE NOT excluded AND pct <= 0.33
  UNION ALL SELECT instrument, 'C-D', day, 'none', morning_end FROM mornings WHERE NOT excluded AND pct >= 0.67
  UNION ALL SELECT instrument, 'C-B', day, direction, ts_utc_ns FROM breaks
  UNION ALL SELECT DISTINCT b.instrument, 'C-C', b.day, b.direction, b.ts_utc_ns FROM breaks b JOIN full_rows r ON r.instrument = b.instrument AND r.rn BETWEEN b.rn + 1 AND b.rn + 60
    AND CASE WHEN b.direction = 'long' THEN r.mid <= b.high - 0.05 * b.atr_bars ELSE r.mid >= b.low + 0.05 * b.atr_bars END)"""
_BOTH = " UNION ALL ".join(f"SELECT e.instrument, '{k}∩{c}' AS context, e.day, e.direction FROM once e WHERE e.context = '{c}' AND EXISTS (SELECT 1 FROM once q WHERE q.instrument = e.instrument AND q.day = e.day AND q.context = '{k}')" for k in ("C-A", "C-D") for c in ("C-B", "C-C"))
_LONDON = f"isodow({local('ts_utc_ns', 'Europe/London')}) AS weekday, hour({local('ts_utc_ns', 'Europe/London')}) AS hour"
def _cuts(table: str, value: str, key: str) -> str:
    """CTEs c1 to c4: each the least value up to which a further fifth of the rows lies, and how many rows do."""
    first = f"p AS (SELECT {key}, {value} AS v, sum(c) OVER (PARTITION BY {key} ORDER BY {value}) AS up_to, sum(c) OVER (PARTITION BY {key}) AS n FROM (SELECT {key}, {value}, count(*) AS c FROM {table} GROUP BY ALL)), c0 AS (SELECT DISTINCT {key}, 0 AS up_to FROM p)"
    cut = "c{k} AS (SELECT p.{key}, min(p.v) AS v, min(p.up_to) AS up_to FROM p JOIN c{b} b ON b.{key} = p.{key} AND p.up_to >= b.up_to + p.n / 5 GROUP BY p.{key})"
    return ", ".join([first, *(cut.format(k=k, b=k - 1, key=key) for k in range(1, 5))])


ORACLE_SQL = {
    "OP64_hour_of_week_report": f"""WITH {BARS}, w60 AS (SELECT *, CASE WHEN rn >= 59 THEN max(mid) OVER w - min(mid) OVER w END AS r FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
      SELECT instrument, {_LONDON}, count(*) AS n, round(quantile_cont(spread_twa, 0.5), 8) AS median_spread, count(r) AS n_range, round(quantile_cont(r, 0.5), 8) AS median_range, round(quantile_cont(spread_twa, 0.5) / nullif(quantile_cont(r, 0.5), 0), 8) AS ratio FROM w60 GROUP BY ALL""",
    "OP65_spread_by_year": f"WITH {BARS} SELECT instrument, year(make_timestamp(ts_utc_ns // 1000)) AS year, count(*) AS n, round(quantile_cont(spread_twa, 0.5), 8) AS median_spread FROM bars GROUP BY ALL",
    "OP66_session_ranges": f"{_RATIOS} " + _MARGINALS.format(q=_q("range", "range") + ", " + _q("ratio", "ratio")),
    "OP66_ranges_by_year": f"WITH {_DAILY} " + _MARGINALS.format(q=_q("range", "range", 6) + ", " + _q("ratio", "ratio", 6)),
    "OP67_quiet_mornings": f"{_RATIOS.replace('WITH', 'WITH RECURSIVE', 1)}, {PCT_SQL}, both_days AS (SELECT r.instrument, r.day, r.ratio, p.pct FROM ratios r JOIN pct p USING (instrument, day) WHERE r.session = 'london' AND p.pct IS NOT NULL), {_fold('both_days', 'pct', 'instrument')}, named AS (SELECT d.*, f.b AS bucket FROM both_days d JOIN folded f ON f.instrument = d.instrument AND f.v = d.pct), {_buckets(8)}",
    "OP67_buckets_by_year": f"WITH RECURSIVE {_DAILY}, both_days AS (SELECT instrument, day, ratio, floor(range / 20000) / 10 AS pct FROM ratios), {_fold('both_days', 'pct', 'instrument')}, named AS (SELECT d.*, f.b AS bucket FROM both_days d JOIN folded f ON f.instrument = d.instrument AND f.v = d.pct), {_buckets(6)}",
    "OP72_box_stats": """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1), v AS (
      SELECT q.*, o_totalprice AS x, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM orders JOIN q USING (o_orderpriority))
      SELECT o_orderpriority, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(x) FILTER (inside) AS low, max(x) FILTER (inside) AS high, count(*) FILTER (NOT inside) AS n_outliers FROM v GROUP BY ALL""",
    "OP73_context_counts": f"WITH {_EVENTS}, once AS (SELECT DISTINCT instrument, context, day, direction FROM found), tagged AS (SELECT * FROM once UNION ALL {_BOTH.replace('AS context', 'AS context', 1)}), spine8 AS (SELECT DISTINCT instrument, year(make_timestamp(ts_utc_ns // 1000)) AS year, unnest(['C-A','C-B','C-C','C-D','C-A∩C-B','C-A∩C-C','C-D∩C-B','C-D∩C-C']) AS context FROM bars) SELECT s.instrument, s.year, s.context, count(t.day) AS n FROM spine8 s LEFT JOIN (SELECT instrument, context, day, year(day) AS year FROM tagged) t USING (instrument, context, year) GROUP BY ALL",
    "OP74_weekdays_by_year": """WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), y AS (SELECT year(d) AS year, count(*) FILTER (isodow(d) <= 5) AS days FROM o GROUP BY 1), g AS (
      SELECT year, unnest(generate_series(make_date(year, 1, 1), make_date(year, 12, 31), INTERVAL 1 DAY)) AS d FROM y) SELECT year, any_value(days) AS days, count(*) FILTER (isodow(d) <= 5) AS n FROM y JOIN g USING (year) GROUP BY year""",
    "OP87_quintiles_of_prices": f"WITH {_cuts('orders', 'o_totalprice', 'o_orderstatus')} SELECT o_orderstatus, CAST(o_totalprice > coalesce(c1.v, 1e300) AS BIGINT) + CAST(o_totalprice > coalesce(c2.v, 1e300) AS BIGINT) + CAST(o_totalprice > coalesce(c3.v, 1e300) AS BIGINT) + CAST(o_totalprice > coalesce(c4.v, 1e300) AS BIGINT) AS bucket, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders LEFT JOIN c1 USING (o_orderstatus) LEFT JOIN c2 USING (o_orderstatus) LEFT JOIN c3 USING (o_orderstatus) LEFT JOIN c4 USING (o_orderstatus) GROUP BY ALL",
    "OP87_quintiles": f"WITH RECURSIVE {_fold('lineitem', 'l_quantity', 'l_returnflag')} SELECT l_returnflag, f.b AS bucket, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem JOIN folded f USING (l_returnflag) WHERE f.v = l_quantity GROUP BY ALL",
    "OP134_morning_days": f"WITH {_MORNING} SELECT instrument, CAST(day AS VARCHAR) AS day, round(high, 8) AS high, round(low, 8) AS low, round(pct, 8) AS pct, CAST(excluded AS BIGINT) AS excluded FROM mornings",
    "OP135_events": f"WITH {_EVENTS} SELECT instrument, context, CAST(day AS VARCHAR) AS day, direction, ts_utc_ns FROM found",
    "OP138_eligible_days": f"WITH {_MORNING} SELECT instrument, CAST(day AS VARCHAR) AS day FROM mornings m WHERE pct IS NOT NULL AND high IS NOT NULL AND EXISTS (SELECT 1 FROM full_rows r WHERE r.instrument = m.instrument AND r.day = m.day AND r.atr_bars IS NOT NULL)",
    "OP139_admissible_years": "SELECT o_orderpriority AS instrument, year(o_orderdate) AS year, round(count(DISTINCT month(o_orderdate)) / 12, 8) AS months_ratio, CAST(count(*) FILTER (o_orderkey % 12001 = 0) AS BIGINT) AS errors, CAST(count(DISTINCT month(o_orderdate)) / 12 >= 0.95 AND count(*) FILTER (o_orderkey % 12001 = 0) = 0 AS BIGINT) AS admissible FROM orders GROUP BY 1, 2",
    "OP140_gate": """WITH c AS (SELECT o_orderpriority AS instrument, year(o_orderdate) * 2 + CAST(month(o_orderdate) > 6 AS INT) AS year, CASE o_orderstatus WHEN 'O' THEN 'C-A∩C-B' WHEN 'F' THEN 'C-A∩C-C' ELSE 'C-D∩C-B' END AS context, count(*) AS n FROM orders GROUP BY ALL),
      per AS (SELECT instrument, context, count(*) AS n_years, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.1) AS p10 FROM c GROUP BY ALL), w AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY median, context) = 1)
      SELECT instrument, n_years, CASE WHEN n_years >= 12 THEN context END AS narrowest, CASE WHEN n_years >= 12 THEN round(median, 8) END AS median, CASE WHEN n_years >= 12 THEN round(p10, 8) END AS p10,
      CASE WHEN n_years < 12 THEN 'INSUFFICIENT_DATA' WHEN median >= 100 AND p10 >= 60 THEN 'PROCEED_GBPUSD' WHEN median >= 100 THEN 'PROCEED_GBPUSD_WITH_INSTABILITY_WARNING' ELSE 'WIDEN_CONTEXT' END AS decision FROM w""",
}

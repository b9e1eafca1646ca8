"""Files and fetching: month files, hour files and logs are made of the driver's tables, in memory, and read by the operators that read files."""

from __future__ import annotations

import lzma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import canonical as C
from tidemark.functions import timex as T
from tidemark.operators import ingest as I
from tidemark.operators import quality as Q
from tidemark.queries.base import TICKS, rounded, table, ticks

CODE = "upper(substr(instrument || 'XXXXX', 1, 6))"
MS = "ts_utc_ns - ts_utc_ns % 1000000"


PIECE = 20_000  # lines


def _dealt(rows: DataFrame, at: str, k: str) -> DataFrame:
    """Rows by hour of an instant, and in the order of the file within it."""
    return rows.withColumn("place", F.struct(F.expr(at).alias("at"), F.col(k).alias("k"))).withColumn("hour", F.expr(f"({at}) div {T.HOUR}")).repartition("hour").sortWithinPartitions("hour", "place")


def _files(lines: DataFrame) -> DataFrame:
    """Month files in pieces (path, part, content) of lines (code, stamp as a timestamp, hour, first, second), dealt out by hour and in order. A piece has
    lines of one hour, 20,000 at most: a whole file need not fit into a task."""
    text = F.concat_ws(",", F.date_format("stamp", "yyyyMMdd HHmmssSSS"), F.format_string("%.6f", "first"), F.format_string("%.6f", "second"), F.lit("0"))
    path = F.concat(F.lit("DAT_ASCII_"), "code", F.lit("_T_"), F.date_format("stamp", "yyyyMM"), F.lit(".csv"))

    def cut(batches):
        hour, held, done = None, {}, {}

        def piece(path, lines):
            done[path] = done.get(path, -1) + 1
            return pd.DataFrame({"path": [path], "part": [hour << 32 | done[path]], "content": ["\n".join(lines).encode("ascii")]})

        for pdf in batches:
            for (now, path), x in pdf.groupby(["hour", "path"], dropna=False)["line"]:  # hours ascend
                if now != hour:
                    yield from (piece(p, rest) for p, rest in held.items() if rest)
                    hour, held, done = now, {}, {}
                rest = held.setdefault(path, [])
                rest.extend(x)
                while len(rest) >= PIECE:
                    yield piece(path, rest[:PIECE])
                    del rest[:PIECE]
        yield from (piece(p, rest) for p, rest in held.items() if rest)

    return lines.select("hour", path.alias("path"), text.alias("line")).mapInPandas(cut, "path string, part long, content binary")


def _tick_lines(spark, sf) -> DataFrame:
    """Ticks with stamps of New York's clock; the ask is moved up so that it is above the bid. VIEWXX has its columns the other way round, and SIGNUP from Saturday, January 13 on."""
    t = _dealt(ticks(spark, sf).select("instrument", "ts_utc_ns", "bid", "ask", "row_sequence"), MS, "row_sequence")
    t = t.withColumn("code", F.expr(CODE)).withColumn("stamp", F.expr(T.wall(MS, T.NEW_YORK))).withColumn("ask", F.round(F.col("ask") + 0.00001, 6))
    swap = (F.col("code") == "VIEWXX") | (F.col("code") == "SIGNUP") & (F.to_date("stamp") >= F.lit("2024-01-13").cast("date"))
    return t.select("code", "stamp", "hour", F.when(swap, F.col("ask")).otherwise(F.col("bid")).alias("first"), F.when(swap, F.col("bid")).otherwise(F.col("ask")).alias("second"))


def op05(spark, sf):
    """Month files to ticks: fields, formats, column order, order of stamps and conversion to UTC."""
    return rounded(I.month_ticks(_files(_tick_lines(spark, sf))).select("instrument", "ts_utc_ns", "bid", "ask", "row_sequence"))


def op124(spark, sf):
    """How the same files were read: the column order of the whole file, or by day with one change over a weekend."""
    how = I.month_readings(_files(_tick_lines(spark, sf)))
    return rounded(how.select("instrument", "year", "month", "n_rows", "column_order"))


def _clock_lines(spark, sf) -> DataFrame:
    """Ticks of every minute or so of four weeks of spring 2024, when the two clocks differ, without weekends: USDSTX stamped by one clock, EUDSTX by the other."""
    start = 1_708_905_600_000_000_000  # 2024-02-26
    li = table(spark, sf, "lineitem").select((F.lit(start) + F.expr(f"(l_orderkey * 7919 + l_linenumber * 104729) * 37 % {28 * 86400} * 1000000000 + l_linenumber * 1000000")).alias("ts_utc_ns"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.round(1 + F.col("l_quantity") / 1000, 6).alias("bid"))
    t = _dealt(li.where(f"not {T.weekend_gap('ts_utc_ns')}"), "ts_utc_ns", "k")
    us, eu = T.wall("ts_utc_ns", T.NEW_YORK), f"{T.instant('ts_utc_ns')} - interval 5 hours"  # London changes on March 31 only
    both = t.withColumn("x", F.explode(F.array(F.struct(F.lit("USDSTX").alias("code"), F.expr(us).alias("stamp")), F.struct(F.lit("EUDSTX").alias("code"), F.expr(eu).alias("stamp")))))
    return both.select("x.code", "x.stamp", "hour", F.col("bid").alias("first"), (F.col("bid") + 0.0001).alias("second"))


def op126(spark, sf):
    """Which clock a file's stamps follow, told from its weekends, and the ticks that come out."""
    files = _files(_clock_lines(spark, sf))
    plans = I.month_plans(files)
    clocks = I.month_readings(files, plans).select("instrument", "year", "month", "stamp_clock")
    t = I.month_ticks(files, plans).groupBy("instrument", "year", "month").agg(F.count(F.lit(1)).alias("n"), F.min("ts_utc_ns").alias("first_ns"), F.max("ts_utc_ns").alias("last_ns"), F.sum(F.expr("ts_utc_ns div 1000000 % 1000003")).alias("checksum"))
    return rounded(clocks.join(t, ["instrument", "year", "month"]))


def op07(spark, sf):
    """Reports of gaps in status texts: a line of each order, a text of each priority."""
    gap = F.format_string("Gap of %ds found between a and b", F.col("o_orderkey") % 5000)
    lines = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("path"), F.when(F.col("o_orderkey") % 7 == 0, gap).when(F.col("o_orderkey") % 7 == 1, F.concat(gap, F.lit("; "), gap)).otherwise("no gap of s found").alias("value"))
    return rounded(I.count_gaps(lines))


def _hour_files(spark, sf) -> DataFrame:
    """Hour files (path, content) of the ticks: compressed records of five numbers; every 97th hour of the year is cut short."""
    hour = "ts_utc_ns div 3600000000000"
    t = ticks(spark, sf).select(F.expr(CODE).alias("code"), F.expr(hour).alias("h"), F.expr("(ts_utc_ns % 3600000000000) div 1000000").alias("ms"), F.round(F.col("bid") * 100_000).cast("long").alias("b"), F.round(F.col("ask") * 100_000).cast("long").alias("a"), "row_sequence")
    paths = I.hour_addresses(t.select(F.col("code").alias("instrument"), "h", (F.col("h") * T.HOUR).alias("hour_ns")).distinct(), "raw").select(F.col("instrument").alias("code"), "h", "path")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ms", "row_sequence"])
        data = np.zeros(len(pdf), I.HOUR_RECORD)
        data["ms"], data["bid"], data["ask"] = pdf["ms"], pdf["b"], pdf["a"]
        raw = data.tobytes()
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [lzma.compress(raw[:-3] if pdf["h"].iloc[0] % 97 == 0 else raw)]})

    return t.join(paths, ["code", "h"]).groupBy("path").applyInPandas(pack, "path string, content binary")


def op08(spark, sf):
    """Hour files to ticks, with prices scaled from whole points."""
    got = I.hour_ticks(_hour_files(spark, sf)).where("error is null")
    return rounded(got.select("instrument", "ts_utc_ns", "bid", "ask", "row_sequence"))


def op115(spark, sf):
    """Blobs that can't be read, as findings."""
    return Q.findings(Q.malformed_samples(I.hour_ticks(_hour_files(spark, sf)))).select("instrument", "check_id", "severity", "count")


def op10(spark, sf):
    """Addresses and paths of every hour that has a tick."""
    hours = ticks(spark, sf).select(F.expr(CODE).alias("instrument"), F.expr(f"ts_utc_ns div {T.HOUR} * {T.HOUR}").alias("hour_ns")).distinct()
    return I.hour_addresses(hours, "raw")


def op11(spark, sf):
    """What answers of a server mean, and how long to wait: orders stand for answers."""
    k = F.col("o_orderkey")
    code = F.element_at(F.array(*map(F.lit, (200, 200, 404, 429, 500))), (k % 5 + 1).cast("int"))
    asked = F.when(k % 3 == 0, F.format_string("%d", k % 40)).when(k % 3 == 1, "soon")
    rows = table(spark, sf, "orders").select("o_orderkey", code.alias("code"), F.when(k % 2 == 0, 0).otherwise(k % 100).alias("size"), (k % 6 + 1).alias("attempt"), asked.alias("retry_after"))
    return rounded(rows.select("o_orderkey", I.fetch_outcome().alias("x")).select("o_orderkey", "x.status", "x.wait_s"))


def op27(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr(T.to_ns("cast(ts as timestamp)")).alias("ts_utc_ns"))


def _walls(spark, sf) -> DataFrame:
    """Each line's shipping day at one of the half hours from midnight to 03:30, as a wall-clock time."""
    half = F.expr("(l_orderkey + l_linenumber) % 8") * (30 * T.MINUTE)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.expr("unix_micros(cast(l_shipdate as timestamp)) * 1000") + half).alias("wall_ns"))


def op29(spark, sf):
    """Wall-clock times that occur twice or not at all, in two zones."""
    flags = {f"{name}_{zone}": f("wall_ns", z).cast("long") for zone, z in (("ny", T.NEW_YORK), ("london", T.LONDON)) for name, f in (("twice", T.is_ambiguous), ("never", T.is_nonexistent))}
    return _walls(spark, sf).withColumns(flags).drop("wall_ns").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


def op30(spark, sf):
    """Instants of wall-clock times, by both policies."""
    both = T.resolve_local(T.resolve_local(_walls(spark, sf), "wall_ns", T.NEW_YORK, "later", "later"), "wall_ns", T.NEW_YORK, "earlier", "earlier")
    return rounded(both.select("l_orderkey", "l_linenumber", "wall_ns", "earlier", "later"))


def op54(spark, sf):
    """Digests of canonical JSON."""

    @F.pandas_udf("string")
    def digest(key: pd.Series, priority: pd.Series, price: pd.Series) -> pd.Series:
        return pd.Series([C.sha256_canonical({"priority": p, "key": int(k), "parts": [int(x), None, True]}) for k, p, x in zip(key, priority, price)])

    return table(spark, sf, "orders").select("o_orderkey", digest("o_orderkey", "o_orderpriority", F.floor("o_totalprice")).alias("sha256"))


def op128(spark, sf):
    """Orders on the eu_dst clock: the changes of their year, and whether they fall between them."""
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"), F.expr("unix_micros(cast(o_orderdate as timestamp)) * 1000").alias("at"))
    found = o.join(I.switches_of(o.select("year").distinct()), "year")
    return found.select("o_orderkey", "spring_ns", "autumn_ns", ((F.col("at") >= F.col("spring_ns")) & (F.col("at") < F.col("autumn_ns"))).cast("long").alias("summer"))


QUERIES = {
    "OP05_month_files": op05, "OP07_gap_reports": op07, "OP08_hour_files": op08, "OP10_addresses": op10, "OP11_fetch_status": op11, "OP115_malformed_blobs": op115, "OP124_column_order_by_day": op124, "OP126_stamp_clock": op126,
    "OP128_eu_switches": op128, "OP27_instants": op27, "OP29_clock_predicates": op29, "OP30_resolve_local": op30, "OP54_canonical_digest": op54,
}

_STAMP = f"timezone('America/New_York', timezone('UTC', make_timestamp(({MS}) // 1000)))"
_LINES = f"{TICKS}, lines AS (SELECT {CODE} AS instrument, {MS} AS ts_utc_ns, bid, round(ask + 0.00001, 6) AS ask, row_sequence AS id, strftime({_STAMP}, '%Y%m') AS m, {_STAMP} AS stamp FROM ticks)"
_HOURS = f"{TICKS}, t AS (SELECT {CODE} AS instrument, ts_utc_ns // 3600000000000 AS h, {MS} AS ts_utc_ns, round(bid * 100000) AS b, round(ask * 100000) AS a, row_sequence AS id FROM ticks)"
_NAME = "printf('%s/%s/%04d/%02d/%02d/%02dh_ticks.bi5', {root}, instrument, year(moment), month(moment){less}, day(moment), hour(moment))"
_GRID = "grid AS (SELECT l_orderkey, l_linenumber, row_number() OVER () AS line, CAST(l_shipdate AS TIMESTAMP) + to_minutes(CAST((l_orderkey + l_linenumber) % 8 * 30 AS INT)) AS w FROM lineitem)"


def _predicates(zone: str, name: str) -> str:
    u = f"timezone('{zone}', w)"
    back = lambda shift: f"timezone('{zone}', {u} {shift}) = w"
    return f"CAST({back('')} AND ({back('- INTERVAL 1 HOUR')} OR {back('+ INTERVAL 1 HOUR')}) AS BIGINT) AS twice_{name}, CAST(NOT {back('')} AS BIGINT) AS never_{name}"


_NY = "timezone('America/New_York', {})"
ORACLE_SQL = {
    "OP05_month_files": f"WITH {_LINES} SELECT instrument, ts_utc_ns, bid, ask, row_number() OVER (PARTITION BY instrument, m ORDER BY ts_utc_ns, id) - 1 AS row_sequence FROM lines",
    "OP07_gap_reports": "SELECT o_orderpriority AS path, CAST(sum(CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) AS BIGINT) AS n_gaps FROM orders GROUP BY 1",
    "OP08_hour_files": f"WITH {_HOURS} SELECT instrument, ts_utc_ns, round(b * 0.00001, 8) AS bid, round(a * 0.00001, 8) AS ask, row_number() OVER (PARTITION BY instrument, h ORDER BY ts_utc_ns, id) - 1 AS row_sequence FROM t WHERE h % 97 <> 0",
    "OP10_addresses": f"WITH {TICKS}, h AS (SELECT DISTINCT {CODE} AS instrument, ts_utc_ns // 3600000000000 * 3600000000000 AS hour_ns FROM ticks), x AS (SELECT *, make_timestamp(hour_ns // 1000) AS moment FROM h) SELECT instrument, hour_ns, {_NAME.format(root=repr(I.HOUR_BASE), less=' - 1')} AS url, {_NAME.format(root=repr('raw'), less='')} AS path FROM x",
    "OP11_fetch_status": """WITH a AS (SELECT o_orderkey, [200, 200, 404, 429, 500][o_orderkey % 5 + 1] AS code, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey % 100 END AS size, o_orderkey % 6 AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 40 END AS asked FROM orders)
      SELECT o_orderkey, CASE code WHEN 200 THEN CASE WHEN size > 0 THEN 'fetched' ELSE 'empty' END WHEN 404 THEN 'empty' WHEN 429 THEN 'rate_limited' ELSE 'failed' END AS status, CASE code WHEN 429 THEN coalesce(asked, least(900.0, 60.0 * power(2, k))) WHEN 500 THEN power(2.0, k) END AS wait_s FROM a""",
    "OP115_malformed_blobs": f"WITH {_HOURS} SELECT instrument, 'E-05' AS check_id, 'ERROR' AS severity, count(DISTINCT h) AS count FROM t WHERE h % 97 = 0 GROUP BY 1",
    "OP124_column_order_by_day": f"WITH {_LINES} SELECT instrument, year(any_value(stamp)) AS year, month(any_value(stamp)) AS month, count(*) AS n_rows, CASE WHEN instrument = 'VIEWXX' THEN 'whole file: ask_bid' WHEN count(DISTINCT stamp < TIMESTAMP '2024-01-13') = 2 AND instrument = 'SIGNUP' THEN 'by day, changing over the weekend of ' || CAST(CAST(max(stamp) FILTER (stamp < TIMESTAMP '2024-01-13') AS DATE) AS VARCHAR) ELSE 'whole file: bid_ask' END AS column_order FROM lines GROUP BY instrument, m",
    "OP126_stamp_clock": f"""WITH l AS (SELECT 1708905600000000000 + (l_orderkey * 7919 + l_linenumber * 104729) * 37 % {28 * 86400} * 1000000000 + l_linenumber * 1000000 AS ts_utc_ns FROM lineitem), n AS (SELECT *, timezone('America/New_York', timezone('UTC', make_timestamp(ts_utc_ns // 1000))) AS ny FROM l),
      o AS (SELECT * FROM n WHERE NOT (isodow(ny) = 6 OR (isodow(ny) = 5 AND hour(ny) >= 17) OR (isodow(ny) = 7 AND hour(ny) < 17))), s AS (SELECT 'USDSTX' AS instrument, ts_utc_ns, ny AS stamp FROM o UNION ALL SELECT 'EUDSTX', ts_utc_ns, make_timestamp(ts_utc_ns // 1000) - INTERVAL 5 HOUR FROM o)
      SELECT instrument, year(stamp) AS year, month(stamp) AS month, CASE WHEN month(stamp) = 2 THEN 'either' WHEN instrument = 'USDSTX' THEN 'us_dst' ELSE 'eu_dst' END AS stamp_clock, count(*) AS n, min(ts_utc_ns) AS first_ns, max(ts_utc_ns) AS last_ns, CAST(sum(ts_utc_ns // 1000000 % 1000003) AS BIGINT) AS checksum FROM s GROUP BY ALL""",
    "OP128_eu_switches": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS moment FROM orders), d AS (SELECT CAST(unnest(generate_series(date_trunc('year', min(moment)), date_trunc('year', max(moment)) + INTERVAL 1 YEAR, INTERVAL 1 DAY)) AS DATE) AS d FROM o), c AS (
      SELECT d, timezone('Europe/London', CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR) - (CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR) AS z FROM d), s AS (SELECT year(d) AS year, month(d) > 6 AS autumn, epoch_us(CAST(d + 1 AS TIMESTAMP)) * 1000 AS ns FROM c QUALIFY z <> lag(z) OVER (ORDER BY d)),
      y AS (SELECT year, max(ns) FILTER (NOT autumn) AS spring_ns, max(ns) FILTER (autumn) AS autumn_ns FROM s GROUP BY year) SELECT o_orderkey, spring_ns, autumn_ns, CAST(epoch_us(moment) * 1000 >= spring_ns AND epoch_us(moment) * 1000 < autumn_ns AS BIGINT) AS summer FROM o JOIN y ON y.year = year(moment)""",
    "OP27_instants": "SELECT event_id, epoch_us(ts) * 1000 AS ts_utc_ns FROM events",
    "OP29_clock_predicates": f"WITH {_GRID} SELECT l_orderkey, l_linenumber, {_predicates('America/New_York', 'ny')}, {_predicates('Europe/London', 'london')} FROM grid",
    "OP30_resolve_local": f"""WITH {_GRID}, c AS (SELECT *, unnest([{_NY.format('w')} - INTERVAL 1 HOUR, {_NY.format('w')}, {_NY.format('w')} + INTERVAL 1 HOUR]) AS u FROM grid), f AS (
      SELECT l_orderkey, l_linenumber, line, w, min(u) FILTER ({_NY.format('u')} = w) AS a, max(u) FILTER ({_NY.format('u')} = w) AS b FROM c GROUP BY ALL)
      SELECT l_orderkey, l_linenumber, epoch_us(w) * 1000 AS wall_ns, coalesce(epoch_us(a) * 1000, epoch_us({_NY.format("date_trunc('hour', w) + INTERVAL 1 HOUR")}) * 1000 - 1) AS earlier, coalesce(epoch_us(b), epoch_us({_NY.format("date_trunc('hour', w) + INTERVAL 1 HOUR")})) * 1000 AS later FROM f""",
    "OP54_canonical_digest": """SELECT o_orderkey, sha256('{"key":' || o_orderkey || ',"parts":[' || CAST(floor(o_totalprice) AS BIGINT) || ',null,true],"priority":"' || o_orderpriority || '"}') AS sha256 FROM orders""",
}

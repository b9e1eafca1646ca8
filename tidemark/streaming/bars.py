"""The bar resampling as a stream: an extension, since ticks are stored by month otherwise.

A watermark says how late a tick may be; a minute is emitted once the watermark has passed its end, and ticks after that are dropped. The
time-weighted spread needs the order of a minute's ticks, so its few ticks are gathered in the aggregation and folded in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timex as T

MINUTE_TICKS = "array<struct<ts_utc_ns:bigint,row_sequence:bigint,bid:double,ask:double>>"


def stream_bars(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks (instrument, ts_utc_ns, bid, ask, row_sequence), in append mode; without prev_gap_ns, which crosses minutes."""
    timed = ticks.withColumn("at", F.expr(T.instant("ts_utc_ns"))).withWatermark("at", late)
    tick = F.struct("ts_utc_ns", "row_sequence", "bid", "ask")
    order = F.struct("ts_utc_ns", "row_sequence")
    spread = F.col("ask") - F.col("bid")
    sides = [f(c).alias(f"{c}_{n}") for c in ("bid", "ask") for n, f in (("o", lambda c: F.min_by(c, order)), ("h", F.max), ("l", F.min), ("c", lambda c: F.max_by(c, order)))]
    g = timed.groupBy("instrument", F.window("at", "1 minute").alias("w")).agg(
        *sides, F.count(F.lit(1)).cast("int").alias("tick_count"), F.min("ts_utc_ns").alias("first_tick_ns"), F.max("ts_utc_ns").alias("last_tick_ns"),
        F.min_by(spread, order).alias("spread_open"), F.max(spread).alias("spread_max"), F.array_sort(F.collect_list(tick)).alias("_t"))
    start = F.expr("unix_micros(w.start) * 1000")
    g = g.withColumn("ts_utc_ns", start)
    until = lambda i: F.coalesce(F.get("_t", i + 1)["ts_utc_ns"], F.col("ts_utc_ns") + T.MINUTE)
    held = F.transform("_t", lambda x, i: (x["ask"] - x["bid"]) * (until(i) - x["ts_utc_ns"]))
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x)
    return g.withColumn("spread_twa", total / (F.col("ts_utc_ns") + T.MINUTE - F.col("first_tick_ns"))).drop("w", "_t")


def stream_counts(ticks: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(instrument, start, end, n_ticks, n_zero_spread) over tumbling or sliding windows of a stream."""
    w = F.window("at", width, slide) if slide else F.window("at", width)
    timed = ticks.withColumn("at", F.expr(T.instant("ts_utc_ns"))).withWatermark("at", late)
    return timed.groupBy("instrument", w.alias("w")).agg(F.count(F.lit(1)).alias("n_ticks"), F.count_if(F.col("ask") == F.col("bid")).alias("n_zero_spread")).select("instrument", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_ticks", "n_zero_spread")


def bounded_bars(spark: SparkSession, source: str, schema: object, out: str, state: str, late: str = "10 minutes") -> DataFrame:
    """Bars of all ticks below a folder, as a stream that ends: it reads what is there, then one tick far ahead of all, whose instrument is null, moves the watermark past the last minute."""
    ticks = lambda: spark.readStream.schema(schema).option("latestFirst", "false").parquet(f"{source}*")

    def run() -> None:
        writer = stream_bars(ticks(), late).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run()
    last = spark.read.schema(schema).parquet(source).agg(F.max("ts_utc_ns")).first()[0]
    if last is None:
        return spark.read.schema(stream_bars(spark.createDataFrame([], schema)).schema).parquet(out)
    for k in (1, 2):  # a watermark counts from the batch after
        row = {"instrument": None, "ts_utc_ns": last + k * T.DAY, "row_sequence": -k}
        spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields)], schema).write.parquet(f"{source.rstrip('/')}-end{k}")
        run()
    return spark.read.parquet(out).where("instrument is not null")

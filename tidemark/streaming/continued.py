"""Gaps and Wilder's average true range that go on from micro-batch to micro-batch: an extension, as the stored tables are made by month.

State is a few numbers for each instrument (the last tick, the last close, how many bars, the average so far) and the bars whose time hasn't come: a bar waits until a timer says that the
watermark has passed its minute, so bars that arrive out of order are taken in order. What is given out is merged into a table with versions, where a later run of a minute wins; a batch that is
given out twice, after a restart, changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import timex as T
from tidemark.sources.ticks import merge_features
from tidemark.sources.versions import VersionedTable

BAR = "ts_utc_ns long, bid_h double, bid_l double, bid_c double, first_tick_ns long, last_tick_ns long"
CONTINUED = "ts_utc_ns long, prev_gap_ns long, atr_bars double"
STORE = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Continued(StatefulProcessor):
    """Bars of one instrument, in order of time; n: the length of the average."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", "last_tick long, close double, bars long, total double")
        self.waiting = handle.getListState("waiting", BAR)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BAR.split(", ")]
        bars = [tuple(v.item() if hasattr(v, "item") else v for v in bar) for part in rows for bar in part[names].itertuples(index=False)]
        self.waiting.appendList(bars)
        # one timer for what a batch brings: all that waits up to its last minute is taken then, in one look
        self.handle.registerTimer((max(bars)[0] + T.MINUTE) // 1_000_000)
        yield pd.DataFrame(columns=["instrument", *(c.split()[0] for c in CONTINUED.split(", "))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1_000_000
        held = sorted(tuple(x) for x in self.waiting.get())
        due, later = [x for x in held if x[0] + T.MINUTE <= until], [x for x in held if x[0] + T.MINUTE > until]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        last, close, bars, total = self.carried.get() if self.carried.exists() else (None, None, 0, 0.0)
        out = []
        for ts, high, low, end, first_tick, last_tick in due:
            if last is not None and first_tick <= last:
                continue  # a minute that is over
            reach = high - low if close is None else max(high - low, abs(high - close), abs(low - close))
            # total: the sum of the first n, then the average
            bars, total = bars + 1, total + reach if bars < self.n - 1 else (total + reach) / self.n if bars == self.n - 1 else ((self.n - 1) * total + reach) / self.n
            out.append((key[0], ts, None if last is None else first_tick - last, total if bars >= self.n else None))
            last, close = last_tick, end
        if due:
            self.carried.update((last, close, bars, total))
        yield pd.DataFrame({"instrument": [x[0] for x in out], "ts_utc_ns": pd.array([x[1] for x in out], "Int64"), "prev_gap_ns": pd.array([x[2] for x in out], "Int64"), "atr_bars": pd.array([x[3] for x in out], "Float64")})

    def close(self) -> None:
        pass


def stream_continued(bars: DataFrame, n: int = 1440, late: str = "10 minutes") -> DataFrame:
    """(instrument, CONTINUED) of a stream of finished bars with BAR's columns. The session's state store must be PROVIDER."""
    names = [c.split()[0] for c in BAR.split(", ")]
    timed = bars.select("instrument", *names, F.expr(T.instant("ts_utc_ns")).alias("at")).withWatermark("at", late)
    return timed.groupBy("instrument").transformWithStateInPandas(statefulProcessor=Continued(n), outputStructType=f"instrument string, {CONTINUED}", outputMode="Append", timeMode="EventTime")


def run_continued(bars: DataFrame, root: str, state: str, n: int = 1440, late: str = "10 minutes") -> VersionedTable:
    """Reads what the stream has and merges each micro-batch into the versioned table at root; state: the stream's checkpoint, from which a later run goes on."""
    spark = bars.sparkSession
    table = VersionedTable(spark, root, CONTINUED, merge_features)

    def merge(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch)

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, PROVIDER)
    try:
        stream_continued(bars, n, late).writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return table


def bounded_continued(bars: DataFrame, place: str, n: int = 1440) -> DataFrame:
    """(instrument, CONTINUED) of all bars, as a stream that is stopped half way, goes on from its checkpoint, and ends: bars far ahead, whose instrument is "", move the watermark past the last minute."""
    spark, source = bars.sparkSession, f"{place}/in"
    rows = bars.select("instrument", *(c.split()[0] for c in BAR.split(", ")))
    low, high = rows.agg(F.min("ts_utc_ns"), F.max("ts_utc_ns")).first()
    if low is None:
        return spark.createDataFrame([], f"instrument string, {CONTINUED}")
    ahead = [spark.createDataFrame([("", high + k * T.DAY, 0.0, 0.0, 0.0, high + k * T.DAY, high + k * T.DAY)], rows.schema) for k in (1, 2)]
    half = (low + high) // 2
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for parts in ([rows.where(F.col("ts_utc_ns") < half)], [rows.where(F.col("ts_utc_ns") >= half), *ahead]):
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(source)  # a micro-batch each
        table = run_continued(stream(), f"{place}/out", f"{place}/state", n)
    return table.read().where("instrument <> ''").select("instrument", *(c.split()[0] for c in CONTINUED.split(", ")))

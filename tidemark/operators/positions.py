"""Exits of open positions: stop, target and time limit of which the first cancels the others, found without copying a position for each minute or day that it is open.

Two levels. The first later day whose prices reach a level is looked up in a tree of the days' best prices, and the first minute of a day (the entry's own, or that one) in a tree of the
day's bars; ticks count of two minutes at most, the entry's and the one found, each looked up in a tree of six hours' ticks. A bar's range reaches a level exactly if one of its ticks does, so nothing is missed.
Positions of one instrument and day (or six hours) are dealt into slices where there are many, and the day's bars (the six hours' ticks) go to each slice.

A long is closed on the bid and a short on the ask. A stop fills at its level or worse; a target must be traded through and fills at its level, never better; the time limit is
a market order at the first tick from then on. A fill whose tick follows more than a minute without ticks slips gap_multiplier times as much and says so: it may lose more than was risked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators.execution import GAP_MULTIPLIER
from tidemark.operators.features import first_at_or_after
from tidemark.sources.scratch import written

POSITIONS = "position_id string, instrument string, side string, entry_ns long, stop double, target double, until_ns long, slip double"
#: Positions that look into one day's bars, or six hours' ticks, in one task.
SLICE = 100_000
_UTC_DAY = 86_400_000_000_000


def first_reached(low: np.ndarray, high: np.ndarray, start: np.ndarray, down: np.ndarray, up: np.ndarray, strict_up: np.ndarray) -> np.ndarray:
    """For each row of start, down and up the first place from start on where low <= down or high >= up (> where strict; the other side is then strict in down); the length if
    there is none. A tree of the best prices over 2, 4, 8 places tells which to skip."""
    lows, highs = [np.where(np.isnan(low), np.inf, low)], [np.where(np.isnan(high), -np.inf, high)]
    while len(lows[-1]) > 1:
        odd = len(lows[-1]) % 2
        a, b = (np.append(x[-1], f) if odd else x[-1] for x, f in ((lows, np.inf), (highs, -np.inf)))
        lows.append(np.minimum(a[::2], a[1::2]))
        highs.append(np.maximum(b[::2], b[1::2]))

    def hits(k: int, node: np.ndarray, who: np.ndarray) -> np.ndarray:
        inside = node < len(lows[k])
        at = np.minimum(node, max(0, len(lows[k]) - 1))
        if not len(lows[k]):
            return np.zeros(len(node), bool)
        under = np.where(strict_up[who], lows[k][at] <= down[who], lows[k][at] < down[who])
        over = np.where(strict_up[who], highs[k][at] > up[who], highs[k][at] >= up[who])
        return inside & (under | over)

    node, found, top = start.astype(np.int64).copy(), np.full(len(start), -1), len(lows) - 1
    for k in range(top + 1):  # up: a node that begins its parent's range is left to the parent
        who = np.flatnonzero((found < 0) & ((node % 2 == 1) | (k == top)))
        hit = hits(k, node[who], who)
        found[who[hit]] = k
        node[who[~hit]] += 1
        node[found < 0] //= 2
    for k in range(top, 0, -1):  # down to the first place
        who = np.flatnonzero(found == k)
        left = node[who] * 2
        node[who] = np.where(hits(k - 1, left, who), left, left + 1)
        found[who] = k - 1
    return np.where(found == 0, node, len(low))


def _reached(asked: pd.DataFrame, prices: pd.DataFrame, start: np.ndarray, of_long: tuple[str, str], of_short: tuple[str, str]) -> np.ndarray:
    """The place in prices that each position reaches first, from its start on: of_long and of_short are the columns of the lowest and highest prices that it is closed on."""
    long = (asked["side"] == "buy").to_numpy(bool)
    stop, target = asked["stop"].to_numpy(float), asked["target"].to_numpy(float)
    out = np.full(len(asked), len(prices))
    for own, (low, high), down, up in ((long, of_long, stop, target), (~long, of_short, target, stop)):
        k = np.flatnonzero(own)
        out[k] = first_reached(prices[low].to_numpy(float), prices[high].to_numpy(float), start[k], down[k], up[k], np.full(len(k), own is long))
    return out


_PRICES = ("bid_l", "bid_h", "ask_l", "ask_h")


def _sliced(asked: DataFrame, prices: DataFrame, keys: list[str], run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], out: str) -> DataFrame:
    """run of the positions asked and the rows of prices of the same keys; where there are many positions, they are dealt into slices and the prices go to each."""
    counts = asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("_slices"))
    left = asked.join(counts, keys).withColumn("_slice", F.pmod(F.xxhash64("position_id"), F.col("_slices")).cast("int"))
    right = prices.join(counts, keys).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    by = [*keys, "_slice"]
    left, right = left.drop("_slices"), right.select(*(F.col(k).alias(f"of_{k}") for k in by), *(c for c in prices.columns if c not in keys))
    kind = asked.schema["position_id"].dataType.simpleString()
    return left.groupBy(*by).cogroup(right.groupBy(*(f"of_{k}" for k in by))).applyInPandas(run, f"position_id {kind}, {out}")


def _first_ranges(asked: DataFrame, prices: DataFrame, keys: list[str], at: str, out: str) -> DataFrame:
    """(position_id, out): the value of at in the first row of prices, within keys, that a position of asked reaches from from_ns on."""

    def run(a: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(at)
        start = np.searchsorted(p[at].to_numpy("int64"), a["from_ns"].to_numpy("int64"))
        place = _reached(a, p, start, ("bid_l", "bid_h"), ("ask_l", "ask_h"))
        hit = place < len(p)
        return pd.DataFrame({"position_id": a["position_id"].to_numpy()[hit], out: p[at].to_numpy("int64")[place[hit]]})

    asked = asked.select(*keys, "position_id", "side", "stop", "target", "from_ns")
    return _sliced(asked, prices.select(*keys, *([] if at in keys else [at]), *_PRICES), keys, run, f"{out} long")


def _first_ticks(near: DataFrame, ticks: DataFrame) -> DataFrame:
    """(position_id, at, price, what, minute, opens): the first tick of the named minute, after the entry and before the time limit, that closes a position of near by its stop or
    target, found in a tree of six hours' ticks: positions and ticks of a minute aren't paired. opens: it is the first of its minute."""

    def run(a: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["at", "row_sequence"])
        at, minute = p["at"].to_numpy("int64"), a["minute"].to_numpy("int64")
        opens = np.searchsorted(at, minute)
        start = np.maximum(opens, np.searchsorted(at, a["entry_ns"].to_numpy("int64"), "right"))
        end = np.searchsorted(at, np.minimum(minute + T.MINUTE, a["until_ns"].to_numpy("int64")))
        place = _reached(a, p, start, ("bid", "bid"), ("ask", "ask"))
        hit = place < end
        a, minute, opens, place = a[hit], minute[hit], opens[hit], place[hit]
        long, stop = (a["side"] == "buy").to_numpy(bool), a["stop"].to_numpy(float)
        price = np.where(long, p["bid"].to_numpy(float)[place], p["ask"].to_numpy(float)[place])
        what = np.where(np.where(long, price <= stop, price >= stop), "stop", "target").astype(object)
        return pd.DataFrame({"position_id": a["position_id"].to_numpy(), "at": at[place], "price": price, "what": what, "minute": minute, "opens": place == opens})

    quarter = F.expr(f"minute div {6 * T.HOUR}").alias("_q")
    asked = near.select("instrument", quarter, "position_id", "side", "stop", "target", "entry_ns", "until_ns", "minute")
    return _sliced(asked, ticks.select("instrument", quarter, "at", "row_sequence", "bid", "ask"), ["instrument", "_q"], run, "at long, price double, what string, minute long, opens boolean")


def exits(positions: DataFrame, bars: DataFrame, ticks: DataFrame, gap_multiplier: float = GAP_MULTIPLIER) -> DataFrame:
    """(position_id, exit_ns, exit_price, outcome, gap_exit): outcome is stop, target or time; all null while neither is reached and no tick comes after the time limit. position_id is
    unique, slip in price units, taken off on stops and time limits. A position's own entry tick is not looked at. bars: of these ticks, by minute."""
    long = F.col("side") == "buy"
    asked = positions.where("until_ns > entry_ns").select("position_id", "instrument", "side", "stop", "target", "entry_ns", "until_ns", F.coalesce("slip", F.lit(0.0)).alias("slip"))
    asked = asked.withColumn("_minute", F.expr(T.minute_start("entry_ns")))
    ranges = bars.select("instrument", "ts_utc_ns", *_PRICES).withColumn("_d", F.expr(f"ts_utc_ns div {_UTC_DAY}"))
    days = ranges.groupBy("instrument", "_d").agg(*((F.min(c) if c.endswith("_l") else F.max(c)).alias(c) for c in _PRICES)).withColumn("day_ns", F.col("_d") * _UTC_DAY)
    later = asked.withColumn("from_ns", F.expr(f"(entry_ns div {_UTC_DAY} + 1) * {_UTC_DAY}")).where("from_ns < until_ns")
    day = _first_ranges(later, days, ["instrument"], "day_ns", "day_ns")
    own = asked.select("position_id", "instrument", "side", "stop", "target", (F.col("_minute") + T.MINUTE).alias("from_ns"), F.expr(f"entry_ns div {_UTC_DAY}").alias("_d"))
    other = asked.join(day, "position_id").select("position_id", "instrument", "side", "stop", "target", F.col("day_ns").alias("from_ns"), F.expr(f"day_ns div {_UTC_DAY}").alias("_d"))
    minute = _first_ranges(own.unionByName(other), ranges, ["instrument", "_d"], "ts_utc_ns", "minute_ns").groupBy("position_id").agg(F.min("minute_ns").alias("minute_ns"))
    near = asked.withColumn("minute", F.col("_minute")).unionByName(asked.join(minute, "position_id").where("minute_ns < until_ns").withColumnRenamed("minute_ns", "minute"))
    t = ticks.select("instrument", F.expr(T.minute_start("ts_utc_ns")).alias("minute"), F.col("ts_utc_ns").alias("at"), "row_sequence", "bid", "ask")
    price = F.when(long, F.col("bid")).otherwise(F.col("ask"))
    first = _first_ticks(near, t)
    hit = first.groupBy("position_id").agg(F.min_by(F.struct("at", "price", "what", "minute", "opens"), "at").alias("f")).select("position_id", "f.*")
    hit = written(hit, "exits")  # read twice, searched for once
    # what no level closes is closed by time
    left = asked.join(hit.select("position_id"), "position_id", "left_anti")
    due = first_at_or_after(left, "until_ns", ticks.select("instrument", "ts_utc_ns"), "ts_utc_ns", ["instrument"], "at").where("at is not null").withColumn("minute", F.expr(T.minute_start("at")))
    firsts = t.join(due.select("instrument", "at").distinct(), ["instrument", "at"]).groupBy("instrument", "at").agg(F.min_by("bid", "row_sequence").alias("bid"), F.min_by("ask", "row_sequence").alias("ask"))
    timed = due.join(firsts, ["instrument", "at"]).withColumn("price", price).select("position_id", "at", "price", F.lit("time").alias("what"), "minute", F.lit(True).alias("opens"))
    gaps = bars.select("instrument", F.col("ts_utc_ns").alias("minute"), "first_tick_ns", "prev_gap_ns")
    found = asked.join(hit.unionByName(timed), "position_id").join(gaps, ["instrument", "minute"], "left")
    gap = F.col("opens") & (F.col("at") == F.col("first_tick_ns")) & (F.coalesce("prev_gap_ns", F.lit(0)) > T.MINUTE)
    found = found.withColumn("gap_exit", F.coalesce(gap, F.lit(False)))
    slip = F.col("slip") * F.when(F.col("gap_exit"), gap_multiplier).otherwise(1.0)
    worst = F.when(F.col("what") == "time", F.col("price")).otherwise(F.when(long, F.least("stop", "price")).otherwise(F.greatest("stop", "price")))
    fill = F.when(F.col("what") == "target", F.col("target")).otherwise(F.when(long, worst - slip).otherwise(worst + slip))
    done = found.select("position_id", F.col("at").alias("exit_ns"), fill.alias("exit_price"), F.col("what").alias("outcome"), "gap_exit")
    return positions.select("position_id").join(done, "position_id", "left")

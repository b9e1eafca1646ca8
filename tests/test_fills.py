"""Fills against a search by hand, and of so many orders and ticks of a day that their pairs can't be gone through."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators import execution as X

M0 = 1_704_708_000_000_000_000
HALF = T.MINUTE // 2


def by_hand(order, ticks):
    """(fill_ns, fill_price, waited_gap) of one order over ticks in order."""
    sign = 1.0 if order.side == "buy" else -1.0
    before = None
    for at, bid, ask in zip(ticks["ts_utc_ns"], ticks["bid"], ticks["ask"]):
        day = at // (24 * T.HOUR)
        gap = before is not None and before // (24 * T.HOUR) == day and at - before > T.MINUTE
        before = at
        price = ask if sign > 0 else bid
        if not order.from_ns <= at < order.until_ns:
            continue
        past = sign * (price - order.level)
        if order.kind == "market":
            return at, price + sign * order.slip, gap
        if order.kind == "stop" and past >= 0:
            return at, (max if sign > 0 else min)(order.level, price) + sign * order.slip, gap
        if order.kind == "limit" and past < 0 and sign * (price + sign * order.slip - order.level) <= 0:
            return at, (min if sign > 0 else max)(order.level, price) + sign * order.slip, gap
    return None


def test_fills_as_by_hand(spark):
    r = np.random.default_rng(3)
    n, m = 300, 400
    ticks = pd.DataFrame({"instrument": "G", "ts_utc_ns": M0 + np.sort(r.integers(0, 4000, n)) * HALF, "bid": np.round(1 + r.integers(0, 30, n) / 10, 6)})
    ticks["ask"], ticks["row_sequence"] = np.round(ticks["bid"] + r.integers(0, 3, n) / 10, 6), np.arange(n)
    start = M0 + r.integers(0, 4000, m) * HALF
    orders = pd.DataFrame({"order_id": np.arange(m).astype(str), "instrument": "G", "kind": r.choice(X.KINDS, m), "side": r.choice(["buy", "sell"], m), "level": np.round(1 + r.integers(-1, 32, m) / 10, 6), "from_ns": start, "until_ns": start + r.integers(-1, 3000, m) * HALF, "slip": r.choice([0.0, 0.1, 0.01], m)})
    got = {x["order_id"]: x for x in X.fills(spark.createDataFrame(orders, X.ORDERS), spark.createDataFrame(ticks.sample(frac=1, random_state=1))).collect()}
    assert len(got) == m
    for order in orders.itertuples():
        x = got[order.order_id]
        assert (None if x["fill_ns"] is None else (x["fill_ns"], x["fill_price"], x["waited_gap"])) == by_hand(order, ticks)


def test_a_crowded_day(spark):
    """100,000 ticks and orders within hours of one day: 10^10 pairs. The price rises once, at the end; half of the orders wait for it."""
    n = 100_000
    k = spark.range(n)
    ticks = k.select(F.lit("G").alias("instrument"), (M0 + F.col("id") * 10**8).alias("ts_utc_ns"), F.when(F.col("id") == n - 1, 2.0).otherwise(1.0).alias("bid"), F.when(F.col("id") == n - 1, 2.1).otherwise(1.1).alias("ask"), F.col("id").alias("row_sequence"))
    orders = k.select(F.col("id").cast("string").alias("order_id"), F.lit("G").alias("instrument"), F.when(F.col("id") % 2 == 0, "stop").otherwise("market").alias("kind"), F.lit("buy").alias("side"), F.lit(1.5).alias("level"), (M0 + F.col("id") * 10**8).alias("from_ns"), F.lit(M0 + 10 * T.HOUR).alias("until_ns"), F.lit(0.0).alias("slip"))
    began = time.monotonic()
    got = X.fills(orders, ticks).select(F.col("order_id").cast("long").alias("k"), "fill_ns", "fill_price").toPandas().sort_values("k")
    assert time.monotonic() - began < 60
    waits = (got["k"] % 2 == 0) | (got["k"] == n - 1)
    assert (got["fill_ns"] == np.where(waits, M0 + (n - 1) * 10**8, M0 + got["k"] * 10**8)).all() and (got["fill_price"] == np.where(waits, 2.1, 1.1)).all()

"""Gaps and average true ranges that a stream carries on, against the batch operators, with a restart in the middle."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators.bars import with_gaps
from tidemark.operators.features import wilder_atr
from tidemark.streaming.continued import run_continued

M0 = 1_704_708_000_000_000_000 // T.MINUTE * T.MINUTE


def test_a_restart_in_the_middle(spark, tmp_path):
    rng, rows = random.Random(1), []
    for name in "AB":
        price, k = 1.0, 0
        for _ in range(60):
            k += rng.choice([1, 1, 1, 2, 40])
            price += rng.uniform(-0.01, 0.01)
            ts = M0 + k * T.MINUTE
            rows.append((name, ts, price + 0.01, price - 0.01, price, ts + rng.randint(0, 9) * 10**9, ts + rng.randint(10, 59) * 10**9))
    rows.sort(key=lambda r: r[1])
    schema = "instrument string, ts_utc_ns long, bid_h double, bid_l double, bid_c double, first_tick_ns long, last_tick_ns long"
    end = rows[-1][1] + T.DAY
    parts = [rows[:50], rows[50:90], rows[90:], [("end", end, 1.0, 1.0, 1.0, end, end)], [("end", end + T.DAY, 1.0, 1.0, 1.0, end + T.DAY, end + T.DAY)]]
    source = f"{tmp_path}/in"
    for k, part in enumerate(parts):
        part = part[::-1]  # out of order within a batch
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        # a query of its own for each part: all that goes on is in the checkpoint
        table = run_continued(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/out", f"{tmp_path}/state", n=5)
    got = {(r["instrument"], r["ts_utc_ns"]): (r["prev_gap_ns"], r["atr_bars"]) for r in table.read().where("instrument <> 'end'").collect()}
    bars = spark.createDataFrame(rows, schema)
    want = wilder_atr(with_gaps(bars.withColumn("prev_gap_ns", F.lit(None).cast("long")).drop("prev_gap_ns"), continuous=True), 5).collect()
    assert len(got) == len(want) == len(rows)
    for r in want:
        gap, atr = got[r["instrument"], r["ts_utc_ns"]]
        assert gap == r["prev_gap_ns"] and (atr is None) == (r["atr_bars"] is None) and (atr is None or atr == pytest.approx(r["atr_bars"], rel=1e-9))
    before = table.versions()
    run_continued(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/out", f"{tmp_path}/state", n=5)
    assert table.versions() == before

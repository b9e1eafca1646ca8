"""Order fills, R and the statistics of trades, by hand."""

import numpy as np
import pytest

from tidemark.functions import timex as T
from tidemark.operators import execution as X
from tidemark.operators import statistics as ST
from tidemark.operators import study as S

M0 = 1_704_708_000_000_000_000
SEC = 10**9
TICK = "instrument string, ts_utc_ns long, bid double, ask double, row_sequence long"


def ticks_of(spark, rows):
    return spark.createDataFrame([("G", M0 + t * SEC, b, a, k) for k, (t, b, a) in enumerate(rows)], TICK)


@pytest.mark.parametrize(
    ("kind", "side", "level", "slip", "rows", "want"),
    [
        ("market", "buy", None, 0.01, [(0, 1.0, 1.1), (1, 2.0, 2.1)], (0, 1.11)), ("market", "sell", None, 0.01, [(0, 1.0, 1.1)], (0, 0.99)),
        ("stop", "buy", 1.2, 0.0, [(0, 1.19, 1.19), (1, 1.2, 1.2)], (1, 1.2)), ("stop", "buy", 1.2, 0.0, [(0, 1.0, 1.1), (1, 1.2, 1.3)], (1, 1.3)), ("stop", "buy", 1.2, 0.0, [(0, 1.2, 1.1)], None),
        ("stop", "sell", 1.0, 0.0, [(0, 1.1, 0.9), (1, 0.8, 0.9)], (1, 0.8)),
        ("limit", "buy", 1.0, 0.0, [(0, 0.9, 1.0), (1, 0.9, 0.95)], (1, 0.95)), ("limit", "buy", 1.0, 0.1, [(0, 0.9, 0.95), (1, 0.8, 0.85)], (1, 0.95)), ("limit", "sell", 1.0, 0.0, [(0, 1.0, 1.1), (1, 1.05, 1.2)], (1, 1.05)),
    ],
)
def test_fill(spark, kind, side, level, slip, rows, want):
    orders = spark.createDataFrame([("o", "G", kind, side, level, M0, M0 + T.HOUR, slip)], X.ORDERS)
    r = X.fills(orders, ticks_of(spark, rows)).first()
    assert (r["fill_ns"], r["fill_price"]) == ((None, None) if want is None else (M0 + want[0] * SEC, pytest.approx(want[1])))


def test_fill_after_a_gap(spark):
    orders = spark.createDataFrame([("o", "G", "stop", "sell", 1.0, M0 + SEC, M0 + T.HOUR, 0.0)], X.ORDERS)
    r = X.fills(orders, ticks_of(spark, [(0, 1.1, 1.2), (900, 0.7, 0.8)])).first()
    assert r["waited_gap"] and r["fill_price"] == 0.7
    trade = spark.createDataFrame([("t", "buy", 1.1, 0.7, 1.1, 1.0)], "trade_id string, side string, entry_price double, exit_price double, entry_reference double, stop_reference double")
    assert X.r_multiples(trade).first()["r_net"] == pytest.approx(-4.0)


def test_ambiguous_bar(spark):
    bars = spark.createDataFrame([("G", M0, 1.3, 0.9, 1.31, 0.91)], "instrument string, ts_utc_ns long, bid_h double, bid_l double, ask_h double, ask_l double")
    trades = spark.createDataFrame([("a", "G", "buy", 1.0, 1.2, M0), ("b", "G", "buy", 0.8, 1.2, M0), ("c", "G", "sell", 1.3, 0.95, M0)], "trade_id string, instrument string, side string, stop double, target double, ts_utc_ns long")
    assert {r["trade_id"]: r["ambiguous"] for r in X.ambiguity(trades, bars).collect()} == {"a": True, "b": False, "c": True}
    got = {r["trade_id"]: (r["outcome"], r["resolved_by"]) for r in X.resolve(trades, ticks_of(spark, [(0, 1.1, 1.11), (5, 1.3, 1.31), (9, 0.9, 0.91)])).collect()}
    assert got == {"a": ("target", "tick"), "b": ("target", "tick"), "c": ("stop", "tick")}
    assert {r["outcome"] for r in X.resolve(trades, ticks_of(spark, [(600, 1.0, 1.1)])).collect()} == {"stop"}


def test_excursions(spark):
    bars = spark.createDataFrame([("G", M0 + k * T.MINUTE, 1.2 + k / 10, 1.0 - k / 10, 1.2, 1.0) for k in range(3)], "instrument string, ts_utc_ns long, bid_h double, bid_l double, ask_h double, ask_l double")
    t = spark.createDataFrame([("t", "G", "buy", 1.1, 1.1, 1.0, M0, M0 + T.MINUTE)], "trade_id string, instrument string, side string, entry_price double, entry_reference double, stop_reference double, entry_ns long, exit_ns long")
    r = X.excursions(t, bars).first()
    assert (r["mae_r"], r["mfe_r"]) == (pytest.approx(-2.0), pytest.approx(2.0))


def test_summary(spark):
    r = ST.summary(spark.createDataFrame([(1, k, x) for k, x in enumerate([2.0, -1.0, -1.0, 0.0, 3.0])] + [(2, 0, 1.0)], "run long, at long, r_net double")).collect()
    one = next(x for x in r if x["run"] == 1)
    assert (one["expectancy_r"], one["wins"], one["profit_factor"], one["max_drawdown_r"]) == (pytest.approx(0.6), 2, pytest.approx(2.5), 2.0)
    assert one["win_low"] == pytest.approx(0.1176, abs=1e-3) and one["win_high"] == pytest.approx(0.7693, abs=1e-3)
    assert next(x for x in r if x["run"] == 2)["profit_factor"] is None


def test_resampling():
    rng = np.random.default_rng(3)
    r = rng.normal(0.2, 1, 300)
    a = ST.resampled(r, 5, 500)
    assert a == ST.resampled(r, 5, 500) and a["low"] < r.mean() < a["high"] and a["drawdown_median"] < a["drawdown_p95"]
    assert ST.resampled(r[:39], 5) is None
    slow = np.convolve(rng.normal(size=2000), np.ones(20) / 20, "valid")
    assert ST.block_length(slow) > 5 > ST.block_length(rng.normal(size=2000)) >= 1
    x = ST.stationary_resamples(np.arange(50.0), 1e9, 20, rng)
    assert ((np.diff(x, axis=1) % 50) == 1).all()


def test_family_and_tiers():
    assert ST.sidak(1) == pytest.approx(0.05) and ST.sidak(10) == pytest.approx(0.005116, abs=1e-6)
    assert ST.evidence_tier(39, 1.0) == ST.evidence_tier(100, -0.1) == ST.evidence_tier(100, 0.1, beats_placebo=False) == "NO EVIDENCE"
    full = dict(robust=True, stressed_low=0.1, good_years=0.7, adjusted_low=0.1)
    assert (ST.evidence_tier(100, 0.1), ST.evidence_tier(100, 0.1, **full), ST.evidence_tier(100, 0.1, **full, validated=True), ST.evidence_tier(100, 0.1, **full, validated=True, held_out=True)) == ("EXPLORATORY", "PROMISING", "VALIDATION-SUPPORTED", "HOLDOUT-SUPPORTED")


def test_breaks_are_known_later(spark):
    rows = [("G", "d", k, m, 0.1, 1.0) for k, m in enumerate([0.9, 1.2, 1.3, 0.95, 1.4, 1.4, 1.4])]
    df = spark.createDataFrame(rows, "instrument string, day string, rn long, mid double, atr_bars double, level double")
    got = S.break_state(df, "level", window=3).orderBy("rn").collect()
    assert [r["broke"] for r in got] == [False, True, False, False, False, False, False]
    assert [r["reentered"] for r in got] == [None, None, None, None, True, None, None]

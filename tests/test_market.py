"""Bars, merges, features with planted futures, quality, reports, events."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators import describe as D
from tidemark.operators import events as E
from tidemark.operators import features as X
from tidemark.operators import quality as Q
from tidemark.operators.bars import resample, resample_report, with_gaps
from tidemark.sources import ticks as S

M0 = 1_704_708_000_000_000_000  # Monday 2024-01-08 10:00 UTC
SEC = 10**9
TICK = "instrument string, ts_utc_ns long, bid double, ask double, bid_volume double, ask_volume double, row_sequence long"


def ticks_of(spark, rows):
    return spark.createDataFrame([("G", t, b, a, None, None, k) for k, (t, b, a) in enumerate(rows)], TICK)


def test_bar_of_a_minute(spark):
    b = resample(ticks_of(spark, [(M0 + 10 * SEC, 1.0, 1.0001), (M0 + 30 * SEC, 1.5, 1.5002), (M0 + 45 * SEC, 1.2, 1.2001), (M0 + 120 * SEC, 1.0, 1.1)])).orderBy("ts_utc_ns").collect()
    assert [r["ts_utc_ns"] for r in b] == [M0, M0 + 2 * T.MINUTE]
    assert b[0]["spread_twa"] == pytest.approx(1.3e-4) and b[0]["spread_open"] == pytest.approx(1e-4) and b[0]["spread_max"] == pytest.approx(2e-4)
    assert (b[0]["bid_o"], b[0]["bid_h"], b[0]["bid_l"], b[0]["bid_c"], b[0]["tick_count"]) == (1.0, 1.5, 1.0, 1.2, 3)
    assert b[1]["spread_twa"] == pytest.approx(b[1]["spread_open"]) == pytest.approx(b[1]["spread_max"])


def test_equal_stamps_and_sides(spark):
    b = resample(ticks_of(spark, [(M0, 1.0, 2.0), (M0, 1.4, 1.9), (M0, 1.2, 2.5)])).first()
    assert (b["bid_o"], b["bid_c"], b["bid_h"], b["ask_o"], b["ask_c"], b["ask_h"]) == (1.0, 1.2, 1.4, 2.0, 2.5, 2.5)


def test_gap_and_report(spark):
    t = ticks_of(spark, [(M0 + 5 * SEC, 1.0, 1.1), (M0 + 7300 * SEC, 1.0, 1.1)])
    b = with_gaps(resample(t)).orderBy("ts_utc_ns").collect()
    assert [r["prev_gap_ns"] for r in b] == [None, 7295 * SEC]
    r = resample_report(t, resample(t), M0, M0 + 3 * T.HOUR).first()
    assert (r["months_expected"], r["months_missing"], r["ticks"], r["bars"], r["minutes_absent"]) == (1, 0, 2, 2, 178)


def test_store_two_runs_are_one(spark, tmp_path):
    rng = np.random.default_rng(1)
    times = np.sort(rng.integers(0, 40 * 86_400, 400)) * SEC + M0
    t = ticks_of(spark, [(int(x), 1 + k / 1e4, 1.0001 + k / 1e4) for k, x in enumerate(times)])
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    b = with_gaps(resample(t))
    S.write_bars(b, whole)
    S.write_bars(b.where("ts_utc_ns % 7 = 0"), parts)
    S.write_bars(b, parts)
    S.write_bars(b, parts)
    assert S.read_bars(spark, whole).collect() == S.read_bars(spark, parts).collect()
    lo, hi = int(times[50]), int(times[300])
    assert S.read_bars(spark, whole, lo, hi).count() == b.where(f"ts_utc_ns >= {lo} and ts_utc_ns < {hi}").count()
    assert S.read_bars(spark, str(tmp_path / "none")).count() == 0
    plan = S.read_bars(spark, whole, lo, hi)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "year#" in plan.split("PartitionFilters")[1][:200]


def test_tick_merge(spark):
    old = ticks_of(spark, [(M0, 1.0, 1.1), (M0, 1.2, 1.3), (M0 + SEC, 1.0, 1.1)])
    again = ticks_of(spark, [(M0, 1.0, 1.1), (M0, 9.0, 9.1)])
    got = sorted((r["ts_utc_ns"] - M0, r["row_sequence"], r["bid"]) for r in S.merge_ticks(old, again).collect())
    assert got == [(0, 0, 1.0), (0, 1, 9.0), (SEC, 2, 1.0)]
    with pytest.raises(S.IntegrityError):
        S.merge_ticks(old.drop("row_sequence"), again)


def test_holes(spark):
    t = S.with_month(ticks_of(spark, [(M0, 1.0, 1.1)]))
    gone = S.missing_months(spark, t, M0, M0 + 70 * T.DAY, ["G"])
    assert S.require_complete(gone, allow_incomplete=True) == [("G", 2024, 2), ("G", 2024, 3)]
    with pytest.raises(S.IntegrityError, match="2024-02"):
        S.require_complete(gone)


def walk(spark, days=9, step=15, seed=4):
    """Bars every few minutes over some days, with a hole of hours on one of them."""
    rng = np.random.default_rng(seed)
    at = np.arange(0, days * 1440, step) * T.MINUTE + (M0 - 10 * T.HOUR)
    at = at[~((at > M0 + 2 * T.DAY) & (at < M0 + 2 * T.DAY + 3 * T.HOUR))]
    mid = 1.25 + np.cumsum(rng.normal(0, 1e-4, len(at))).round(6)
    b = pd.DataFrame({"instrument": "G", "ts_utc_ns": at, "first_tick_ns": at, "last_tick_ns": at + SEC})
    for side, shift in (("bid", 0.0), ("ask", 2e-4)):
        for k, d in (("o", 0), ("h", 1e-5), ("l", -1e-5), ("c", 0)):
            b[f"{side}_{k}"] = mid + shift + d
    b["spread_twa"] = 2e-4
    return with_gaps(spark.createDataFrame(b))


PARAMS = {"atr_bars": {"n": 14}, "rv_60m": {"n": 10, "gap_ns": T.HOUR}, "pre_london_range_pct": {"n": 3}}


@pytest.mark.parametrize("names", [["atr_bars", "rv_60m"], ["pre_london_high", "pre_london_low", "london_range", "new_york_high", "new_york_range", "pre_london_range_pct"]])
def test_no_feature_sees_the_future(spark, names):
    """A feature of the bars up to an instant is the same whatever comes after it."""
    bars = walk(spark).persist()
    whole = {r["ts_utc_ns"]: tuple(r)[2:] for r in X.compute(names, bars, params=PARAMS).collect()}
    assert any(v is not None for r in whole.values() for v in r)
    for cut in (M0 + 3 * T.DAY + 61 * T.MINUTE, M0 + 5 * T.DAY):
        past = X.compute(names, bars.where(f"ts_utc_ns < {cut}"), params=PARAMS).collect()
        assert all(tuple(r)[2:] == pytest.approx(whole[r["ts_utc_ns"]], nan_ok=True) if None not in tuple(r)[2:] else tuple(r)[2:] == whole[r["ts_utc_ns"]] for r in past)
        other = bars.withColumns({c: F.when(F.col("ts_utc_ns") >= cut, F.col(c) * 3).otherwise(F.col(c)) for c in ("bid_h", "bid_l", "bid_c", "ask_c")})
        changed = {r["ts_utc_ns"]: tuple(r)[2:] for r in X.compute(names, other, params=PARAMS).where(f"ts_utc_ns < {cut}").collect()}
        assert all(v == whole[k] for k, v in changed.items())


def test_a_leaky_feature_is_caught(spark):
    bars = walk(spark, days=2)
    leaky = lambda b: b.select("ts_utc_ns", F.max("bid_c").over(X.W.partitionBy("instrument")).alias("x"))
    whole = {r["ts_utc_ns"]: r["x"] for r in leaky(bars).collect()}
    assert any(r["x"] != whole[r["ts_utc_ns"]] for r in leaky(bars.where(f"ts_utc_ns < {M0}")).collect())


def test_atr_is_wilders(spark):
    bars = walk(spark, days=4)
    rows = X.wilder_atr(bars, 14).orderBy("ts_utc_ns").collect()
    tr = [r["tr"] for r in X.true_range(bars).orderBy("ts_utc_ns").collect()]
    want = [None] * 13 + [float(np.mean(tr[:14]))]
    for x in tr[14:]:
        want.append((want[-1] * 13 + x) / 14)
    assert [r["atr_bars"] for r in rows] == [None if w is None else pytest.approx(w, rel=1e-9) for w in want]


def test_recurrence_over_blocks(spark):
    from tidemark.operators.sequence import recurrence

    x = np.random.default_rng(2).normal(size=500)
    df = spark.createDataFrame([("k", k, float(v)) for k, v in enumerate(x)], "key string, rn long, x double")
    y, want = 0.0, []
    for v in x:
        y = 0.9 * y + v
        want.append(y)
    got = [r["y"] for r in recurrence(df, ["key"], 0.9, "x", "y", block=16).orderBy("rn").collect()]
    assert got == pytest.approx(want, rel=1e-9)


def test_new_york_range_is_shown_once(spark):
    """Each day has a range of its own; the day after sees it, not the one before."""
    rows = []
    for k in range(4):
        for at, mid in ((13, 1.0), (14, 1.0 + (k + 1) / 100)):
            rows.append(("G", M0 - 10 * T.HOUR + k * T.DAY + at * T.HOUR, mid, mid))
    bars = spark.createDataFrame(rows, "instrument string, ts_utc_ns long, bid_c double, ask_c double")
    got = [r["new_york_range"] for r in X.compute(["new_york_range"], bars).orderBy("ts_utc_ns").collect()]
    assert got == [None, None, *(pytest.approx(k / 100) for k in (1, 1, 2, 2, 3, 3))]


def test_registry():
    assert X.resolve(["rv_60m", "atr_bars"]) == ["rv_60m", "atr_bars"]
    with pytest.raises(X.FeatureError):
        X.resolve(["nothing"])
    with pytest.raises(X.FeatureError):
        X.register(X.Feature("atr_bars"))
    with pytest.raises(X.FeatureError):
        X.register(X.Feature("new", requires=("missing",)))


def test_findings(spark):
    t = ticks_of(spark, [(M0, 1.0, 1.1), (M0, 1.0, 1.1), (M0 + SEC, 1.0, 0.9), (M0, 1.0, 1.0), (M0 + 2 * SEC, -1.0, 1.0)])
    samples = Q.tick_samples(t)
    found = {r["check_id"]: r for r in Q.findings(samples).collect()}
    first = {r["check_id"]: r["sample"] for r in Q.first_samples(samples, 10).collect()}
    assert {k: r["count"] for k, r in found.items()} == {"E-01": 1, "E-02": 1, "E-03": 1, "W-01": 1, "W-07": 1, "I-02": 1}
    assert first["E-01"] == ["2024-01-08T10:00:01.000000Z"] and first["I-02"] == ["2024-01"]
    assert not Q.sealable(Q.findings(samples)) and Q.sealable(Q.findings(Q.tick_samples(t.limit(1))))


def test_all_samples_are_kept(spark, tmp_path):
    """A report shows ten of a finding's samples, what is stored beside it has all."""
    from tidemark import report

    t = ticks_of(spark, [(M0 + k * SEC, 1.0, 0.9 if k % 2 else 1.1) for k in range(60)])
    samples = Q.tick_samples(t)
    report.quality_report(tmp_path / "q.md", samples, "test")
    stored = spark.read.parquet(str(tmp_path / "q.samples.parquet")).where("check_id = 'E-01'")
    assert stored.count() == stored.select("sample").distinct().count() == 30
    line = next(x for x in (tmp_path / "q.md").read_text().splitlines() if "E-01" in x)
    assert line.count("2024-01-08T") == 10 and "| 30 |" in line
    assert spark.read.parquet(str(tmp_path / "q.parquet")).where("check_id = 'E-01'").first()["count"] == 30


def test_trailing_deviation_of_any_reach(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(1.2, 1e-4, 400)
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "k long, x double")
    w = Q.W.partitionBy(F.lit(0)).orderBy("k")
    got = {r["k"]: r["sd"] for r in df.select("k", Q.trailing_sd("x", w, 50).alias("sd")).collect()}
    assert all((got[k] is None) == (k < 50) for k in range(400))
    assert all(got[k] == pytest.approx(float(np.std(v[k - 50 : k])), rel=1e-4) for k in range(50, 400))


def test_weekend_margin(spark):
    friday = 1_705_096_800 * SEC  # 2024-01-12 22:00 UTC, 17:00 in New York
    assert [Q.weekend_activity(ticks_of(spark, [(friday + d * T.MINUTE, 1.0, 1.1)])).count() for d in (-1, 3, 6)] == [0, 0, 1]


def test_clock_change_days(spark):
    rows = [("G", T.utc_ns(pd.Timestamp("2024-03-01", tz="UTC").to_pydatetime()) + k * 6 * T.HOUR) for k in range(80)]
    bars = spark.createDataFrame(rows, "instrument string, ts_utc_ns long")
    got = Q.clock_change_days(bars).collect()
    assert [(str(r["day"]), (r["end_ns"] - r["start_ns"]) // T.HOUR) for r in got] == [("2024-03-10", 23)] and got[0]["n_bars"] > 0


def test_quintiles_keep_ties(spark):
    def buckets(values):
        df = spark.createDataFrame([("k", float(v)) for v in values], "key string, v double")
        return [r["bucket"] for r in D.quintiles(df, "v", ["key"]).orderBy("v").collect()]

    assert buckets(range(10)) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert buckets([0, 1, 1, 1, 2, 3, 4, 5, 6, 7]) == [0, 0, 0, 0, 1, 1, 2, 2, 3, 3]
    assert buckets([1] * 9 + [2]) == [0] * 9 + [1]


def test_quintiles_both_ways(spark):
    rng = np.random.default_rng(3)
    values = {"few": rng.integers(0, 6, 300), "one": np.zeros(50), "many": rng.normal(size=301), "two": np.array([1.0, 2.0]), "lumps": np.repeat(np.arange(9), rng.integers(1, 80, 9))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("few", None)], "k string, v double")
    both = [sorted(map(tuple, D.quintiles(df, "v", ["k"], few=few).select("k", "v", "bucket").collect())) for few in (True, False)]
    assert both[0] == both[1] and len(both[0]) == sum(map(len, values.values()))


def test_statistic_of_the_grouped_bootstrap(spark):
    rng = np.random.default_rng(1)
    vs = np.sort(rng.exponential(size=50))
    df = spark.createDataFrame([(1, float(v)) for v in vs], "k long, v double")
    median = D.grouped_bootstrap(df, ["k"], "v", F.lit(3), 200).first()
    mean = D.grouped_bootstrap(df, ["k"], "v", F.lit(3), 200, statistic=np.mean, name="mean").first()
    assert tuple(median)[2:] == D.bootstrap_ci(vs, 3, 200) and tuple(mean)[2:] == D.bootstrap_ci(vs, 3, 200, statistic=np.mean) and mean["mean"] == pytest.approx(vs.mean())


def test_bootstrap():
    v = np.random.default_rng(0).normal(size=200)
    a = D.bootstrap_ci(v, 7, 300)
    assert a == D.bootstrap_ci(v, 7, 300) and a != D.bootstrap_ci(v, 8, 300) and a[1] < a[0] < a[2]
    assert D.bootstrap_ci(np.full(20, 3.0), 1) == (3.0, 3.0, 3.0)
    cells, D._CELLS = D._CELLS, 1000
    try:
        assert D.bootstrap_ci(v, 7, 300) == a
    finally:
        D._CELLS = cells
    with pytest.raises(ValueError):
        D.bootstrap_ci(np.zeros(0), 1)


def test_small_groups_have_no_interval(spark):
    df = spark.createDataFrame([("a", 1.0)] * 9 + [("b", float(k)) for k in range(10)], "k string, v double")
    got = {r["k"]: r for r in D.grouped_bootstrap(df, ["k"], "v", F.lit(1), 100).collect()}
    assert got["a"]["ci_low"] is None and got["a"]["n"] == 9 and got["b"]["ci_low"] is not None


def test_box(spark):
    df = spark.createDataFrame([("k", float(v)) for v in [*range(1, 10), 100]], "key string, v double")
    r = D.box_stats(df, ["key"], "v").first()
    assert (r["low"], r["high"], r["n_outliers"]) == (1.0, 9.0, 1) and [x["v"] for x in D.outliers(df, ["key"], "v").collect()] == [100.0]


@pytest.mark.parametrize(("values", "widened", "want"), [([120] * 12, False, E.PROCEED), ([150] * 10 + [10] * 3, False, E.UNSTABLE), ([60] * 12, True, E.WIDEN), ([5] * 12, False, E.WIDEN), ([5] * 12, True, E.FALLBACK), ([500] * 11, False, E.INSUFFICIENT)])
def test_gate(spark, values, widened, want):
    counts = spark.createDataFrame([("G", 2000 + k, c, n if c == "C-A∩C-B" else 10_000) for k, n in enumerate(values) for c in E.BOTH], "instrument string, year int, context string, n long")
    good = spark.createDataFrame([("G", 2000 + k, True) for k in range(len(values))], "instrument string, year int, admissible boolean")
    r = E.gate(counts, good, widened).first()
    assert r["decision"] == want and r["narrowest"] == (None if want == E.INSUFFICIENT else "C-A∩C-B")


def test_holdout():
    E.guard_holdout(E.HOLDOUT_NS)
    with pytest.raises(E.VaultError):
        E.guard_holdout(E.HOLDOUT_NS + 1)
    with pytest.raises(ValueError):
        E.widened(E.Params(), "other")
    assert E.widened(E.Params(), "range_pct_max").range_pct_max == 0.40


def test_counts_by_year(spark):
    day = lambda d: pd.Timestamp(f"2010-01-{d:02d}").date()
    rows = [("G", "C-A", day(4), "none"), ("G", "C-B", day(4), "long"), ("G", "C-B", day(4), "short"), ("G", "C-C", day(4), "long"), ("G", "C-D", day(5), "none"), ("G", "C-B", day(5), "long"), ("G", "C-B", day(6), "long")]
    ev = spark.createDataFrame([(i, c, d, x, 0, {}) for i, c, d, x in rows], E.EVENTS)
    got = {r["context"]: r["n"] for r in E.counts_by_year(ev, spark.createDataFrame([("G", 2010)], "instrument string, year int")).collect()}
    assert got == {"C-A": 1, "C-B": 4, "C-C": 1, "C-D": 1, "C-A∩C-B": 2, "C-A∩C-C": 1, "C-D∩C-B": 1, "C-D∩C-C": 0}

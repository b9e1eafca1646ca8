"""Selection, split intervals, scans, exits, slippage, lower bounds, as-of: against numpy and by hand, and the same however rows are dealt out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators import execution as X
from tidemark.operators import features as FX
from tidemark.operators import positions as PO
from tidemark.operators import robustness as R
from tidemark.operators import scan as SC
from tidemark.operators import statistics as ST
from tidemark.operators.resampling import _stream, drawn, middle_ranks, mix, split_bootstrap
from tidemark.operators.selection import at_ranks, quantiles, selected_quantiles

M0 = 1_704_708_000_000_000_000
SEC = 10**9


def test_selection_is_a_sort(spark):
    rng = np.random.default_rng(1)
    values = [*rng.normal(size=400), *rng.integers(-3, 3, 200).astype(float), 0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 1e308, -1e308]
    df = spark.createDataFrame([(k % 2 if k % 9 else None, float(v) if k % 50 else None) for k, v in enumerate(values)], "g long, v double")
    groups = {}
    for g, v in [(k % 2 if k % 9 else None, v) for k, v in enumerate(values) if k % 50]:
        groups.setdefault(g, []).append(v + 0.0)
    wanted = spark.createDataFrame([(g, r) for g, vs in groups.items() for r in range(0, len(vs) + 2)], "g long, rank long")
    passes = [sorted(map(str, at_ranks(df, ["g"], "v", wanted, direct=d).collect())) for d in (10**6, 0)]
    assert passes[0] == passes[1]
    got = {}
    for r in at_ranks(df, ["g"], "v", wanted).collect():
        got.setdefault(r["g"], {})[r["rank"]] = r["value"]
        assert r["below"] <= r["rank"] < r["below"] + r["equal"]
    for g, vs in groups.items():
        want = np.sort(np.array(vs))
        assert np.array_equal(np.array([got[g][k] for k in range(len(vs))]), want, equal_nan=True) and len(got[g]) == len(vs)


def test_selected_quantiles_are_percentiles(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 > 0, F.sin("id") * F.pow(F.lit(10.0), F.col("id") % 7)).alias("v"))
    probs = [0.0, 0.013, 0.25, 0.5, 0.75, 0.999, 1.0]
    same = [{r["g"]: (r["n"], r["q"]) for r in f.collect()} for f in (selected_quantiles(df, ["g"], "v", probs), quantiles(df.repartition(7), ["g"], "v", probs), quantiles(df, ["g"], "v", probs, buffered=10))]
    assert same[0] == same[1] == same[2]


def test_draws_are_even():
    x = drawn(7, np.arange(200), 0, 1000, 1000)
    assert x.min() == 0 and x.max() == 999 and abs(x.mean() - 499.5) < 3
    counts = np.bincount(x.ravel(), minlength=1000)
    assert abs(((counts - 200) ** 2 / 200).sum() - 999) < 5 * math.sqrt(2 * 999)
    rows = x - x.mean(axis=1, keepdims=True)
    assert abs((rows[:-1] * rows[1:]).mean()) / rows.var() < 0.02 and abs((rows[:, :-1] * rows[:, 1:]).mean()) / rows.var() < 0.02
    assert len(set(map(int, _stream(7, np.arange(5000))))) > 4990 and int(mix(np.array([0], np.uint64))[0]) == 0


def test_middle_ranks_in_blocks():
    for n in (10, 11, 999, 3000):
        whole, pieces = middle_ranks(3, 0, 40, n), middle_ranks(3, 0, 40, n, block=7)
        assert all(np.array_equal(a, b) for a, b in zip(whole, pieces))
        x = np.sort(drawn(3, np.arange(40), 0, n, n), axis=1)
        assert np.array_equal(whole[0], x[:, (n - 1) // 2]) and np.array_equal(whole[1], x[:, n // 2])


def test_split_bootstrap(spark):
    rng = np.random.default_rng(5)
    values = {1: rng.exponential(size=901), 2: rng.normal(size=40), 3: rng.normal(size=5)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g long, v double")
    results = []
    for parts, task_draws in ((1, 20_000_000), (7, 3000), (64, 50)):
        results.append({r["g"]: tuple(r)[1:] for r in split_bootstrap(df.repartition(parts), ["g"], "v", F.lit(11) + F.col("g"), 300, task_draws=task_draws).collect()})
    assert results[0] == results[1] == results[2]
    for g, vs in values.items():
        n, median, low, high = results[0][g]
        assert n == len(vs) and median == np.median(vs)
        if g == 3:
            assert low is high is None
            continue
        medians = np.median(np.sort(vs)[drawn(11 + g, np.arange(300), 0, n, n)], axis=1)
        assert [low, high] == pytest.approx(list(np.percentile(medians, [2.5, 97.5])))
        plain = np.percentile(np.median(rng.choice(vs, (2000, n)), axis=1), [2.5, 97.5])
        assert abs(low - plain[0]) + abs(high - plain[1]) < 0.35 * (plain[1] - plain[0])


BAR = "instrument string, ts_utc_ns long, bid_c double, ask_c double, mid double"


def day_bars(spark, mids):
    return spark.createDataFrame([("G", M0 + k * T.MINUTE, m - 0.01, m + 0.01, float(m)) for k, m in enumerate(mids)], BAR)


def test_scan_sees_nothing_later(spark):
    bars = day_bars(spark, [1.0, 1.1, 1.05, 1.2, 1.3])

    def breaks(ctx):
        return SC.Candidate("long", ctx.bars.at("ask_c", ctx.i), 1.0) if ctx.i and ctx.bars["mid"][-1] > ctx.bars["mid"][:-1].max() else None

    got = SC.scan_days(bars, breaks).collect()
    assert [r["ts_utc_ns"] for r in got] == [M0 + k * T.MINUTE for k in (1, 3, 4)] and got[0]["entry_reference"] == pytest.approx(1.11)
    later = lambda ctx: SC.Candidate("long", ctx.bars.at("mid", ctx.i + 1), 1.0)
    with pytest.raises(Exception, match="LookaheadError"):
        SC.scan_days(bars, later).collect()
    calls = []
    with pytest.raises(Exception, match="PurityError"):
        SC.scan_days(bars, lambda ctx: calls.append(1) or SC.Candidate("long", float(len(calls)), 1.0)).collect()
    writes = lambda ctx: ctx.bars["mid"].__setitem__(0, 9.0)
    with pytest.raises(Exception, match="read-only"):
        SC.scan_days(bars, writes).collect()
    with pytest.raises(ValueError):
        SC.Candidate("up", 1.0, 1.0)


def test_leaky_features_are_refused(spark):
    bars = day_bars(spark, [1.0 + math.sin(k) / 10 for k in range(60)])
    w = FX.W.partitionBy("instrument").orderBy("ts_utc_ns")
    signals = lambda rows: SC.scan_days(rows, lambda ctx: SC.Candidate("long", 1.0, 0.9) if ctx.features.at("x", ctx.i) > 0.5 else None, features=("x",))
    honest, leaky = (lambda b, k=k: b.withColumn("x", F.lag("mid", k).over(w)) for k in (1, -1))
    cuts = SC.cut_points(bars, 4)
    SC.refuse_leaks(bars, honest, signals, cuts)
    with pytest.raises(SC.LookaheadError):
        SC.refuse_leaks(bars, leaky, signals, cuts)


TICK = "instrument string, ts_utc_ns long, bid double, ask double, row_sequence long"


def market(spark, rows):
    from tidemark.operators.bars import resample, with_gaps

    ticks = spark.createDataFrame([("G", M0 + int(t * SEC), float(b), float(b + 0.01), k) for k, (t, b) in enumerate(rows)], TICK)
    full = ticks.withColumns({"bid_volume": F.lit(None).cast("double"), "ask_volume": F.lit(None).cast("double")})
    return with_gaps(resample(full), continuous=True), ticks


def test_exits(spark):
    day = 86_400
    path = [(0, 1.0), (10, 1.02), (70, 1.05), (75, 0.98), (130, 1.2), (2 * day, 1.01), (2 * day + 20, 0.7), (2 * day + 30, 1.5), (5 * day, 1.1)]
    bars, ticks = market(spark, path)
    rows = [
        ("same minute", "buy", 0, 0.5, 1.015, 100 * day), ("next minute", "buy", 0, 0.98, 1.5, 100 * day), ("order in a minute", "buy", 0, 0.985, 1.04, 100 * day), ("gap", "buy", 80, 0.75, 1.4, 100 * day), ("touch", "buy", 0, 0.1, 1.2, day),
        ("time", "buy", 0, 0.1, 9.0, 3 * day), ("open", "buy", 0, 0.1, 9.0, 100 * day), ("short stop", "sell", 0, 1.1, 0.1, 100 * day), ("short target", "sell", 0, 9.0, 0.9, 100 * day), ("no levels", "sell", 0, None, None, 60), ("own tick", "buy", 10, 0.5, 1.01, 100 * day),
    ]
    pos = spark.createDataFrame([(i, "G", s, M0 + e * SEC, None if a is None else float(a), None if b is None else float(b), M0 + u * SEC, 0.001) for i, s, e, a, b, u in rows], PO.POSITIONS)
    got = {r["position_id"]: (None if r["exit_ns"] is None else (r["exit_ns"] - M0) // SEC, r["outcome"], r["exit_price"], r["gap_exit"]) for r in PO.exits(pos, bars, ticks).collect()}
    near = lambda x: pytest.approx(x, abs=1e-12)
    assert got["same minute"] == (10, "target", near(1.015), False)
    assert got["next minute"] == (75, "stop", near(0.98 - 0.001), False)
    assert got["order in a minute"] == (70, "target", near(1.04), False)
    assert got["gap"] == (2 * 86_400 + 20, "stop", near(0.7 - 0.001), False)
    assert got["touch"] == (2 * 86_400, "time", near(1.01 - 0.003), True)
    assert got["time"] == (5 * 86_400, "time", near(1.1 - 0.003), True)
    assert got["open"] == (None, None, None, None)
    assert got["short stop"] == (130, "stop", near(1.21 + 0.001), False) and got["short target"][:2] == (2 * 86_400 + 20, "target")
    assert got["no levels"] == (70, "time", near(1.06 + 0.001), False) and got["own tick"][0] == 70


def test_a_weekend_gap_loses_more_than_was_risked(spark):
    bars, ticks = market(spark, [(0, 1.1), (30, 1.1), (200_000, 0.9), (200_010, 0.95)])
    pos = spark.createDataFrame([("p", "G", "buy", M0 + SEC, 1.05, 1.3, M0 + 10**15, 0.001)], PO.POSITIONS)
    r = PO.exits(pos, bars, ticks).first()
    assert (r["outcome"], r["gap_exit"], r["exit_price"]) == ("stop", True, pytest.approx(0.9 - 0.003))
    trade = spark.createDataFrame([("p", "buy", 1.11, r["exit_price"], 1.11, 1.05)], "position_id string, side string, entry_price double, exit_price double, entry_reference double, stop_reference double")
    assert X.r_multiples(trade).first()["r_net"] < -1


def test_exits_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    path = [(k * 700 + float(rng.integers(0, 600)), 1 + 0.1 * math.sin(k / 9) + rng.normal() / 50) for k in range(600)]
    bars, ticks = market(spark, path)
    rows = [(f"p{k}", "G", ("buy", "sell")[k % 2], M0 + int(path[k][0] * SEC), path[k][1] - (-1) ** k * 0.05, path[k][1] + (-1) ** k * 0.06, M0 + int(path[k][0] * SEC) + 86_400 * SEC * (1 + k % 4), 0.0) for k in range(0, 500)]
    pos = spark.createDataFrame(rows, PO.POSITIONS)
    whole = sorted(map(str, PO.exits(pos, bars, ticks).collect()))
    monkeypatch.setattr(PO, "SLICE", 7)
    assert sorted(map(str, PO.exits(pos, bars, ticks).collect())) == whole
    t = [(M0 + int(s * SEC), b, b + 0.01) for s, b in path]
    found = {r["position_id"]: (r["exit_ns"], r["outcome"]) for r in PO.exits(pos, bars, ticks).collect()}
    for i, _, side, entry, stop, target, until, _ in rows:
        want = (None, None)
        for ts, bid, ask in t:
            if ts <= entry:
                continue
            hit = "time" if ts >= until else ("stop" if (bid <= stop if side == "buy" else ask >= stop) else "target" if (bid > target if side == "buy" else ask < target) else None)
            if hit:
                want = (ts, hit)
                break
        assert found[i] == want


def test_slippage(spark):
    o = spark.range(20_000).select(F.col("id").cast("string").alias("order_id"), F.element_at(F.array(F.lit("market"), F.lit("stop"), F.lit("limit")), (F.col("id") % 3 + 1).cast("int")).alias("kind"), F.lit(0.01).alias("spread_twa"))
    s = X.slippage(o, 5)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, X.slippage(o.repartition(5), 5).collect())) != sorted(map(tuple, X.slippage(o, 6).collect()))
    by = {r["kind"]: r for r in s.groupBy("kind").agg(F.avg("slip").alias("m"), F.min("slip").alias("lo"), F.max("slip").alias("hi")).collect()}
    assert by["stop"]["m"] == pytest.approx(0.5 * 0.01 * math.sqrt(2 / math.pi), rel=0.03) and by["market"]["m"] == pytest.approx(by["stop"]["m"] / 2, rel=0.05)
    assert by["limit"]["hi"] == 0 and 0 <= by["stop"]["lo"] and 0.01 < by["stop"]["hi"] <= 0.5 * 0.01 * X.SIGMAS
    fitted = X.fit_slippage(s.withColumnRenamed("slip", "jump"), ["kind"]).collect()
    assert {r["kind"]: r["k"] for r in fitted} == pytest.approx({"market": 0.25, "stop": 0.5, "limit": 0.0}, abs=0.01)


def test_half_normal(spark):
    from statistics import NormalDist

    z = NormalDist()
    for p in (0.0, 0.1, 0.5, 0.9, 0.95, 0.97, 0.999, 1.0):
        want = z.inv_cdf(0.5 + p * (z.cdf(X.SIGMAS) - 0.5))
        assert spark.sql(f"select {X.half_normal(f'cast({p} as double)')} as z").first()["z"] == pytest.approx(want, abs=1e-7)


TRADES = "run long, trade_id long, day string, r_net double, cost double"


def test_lower_bounds(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(0.2, 1.0, 400).round(6)
    t = spark.createDataFrame([(1, k, "2020-01-01", float(x), 0.25) for k, x in enumerate(r)], TRADES)
    found = [sorted(map(tuple, R.lower_bounds(t.repartition(n), ["run"], 9, F.col("cost"), (1.0, 2.0)).collect())) for n in (1, 5)]
    assert found[0] == found[1]
    one, two = found[0]
    assert one[2] == 400 and one[3] == pytest.approx(r.mean()) and two[3] == pytest.approx(r.mean() - 0.25)
    assert two[4] - one[4] == pytest.approx(-0.25, abs=1e-9)  # no noise between multipliers
    plain = np.percentile(rng.choice(r, (4000, 400)).mean(axis=1), 2.5)
    assert one[4] == pytest.approx(plain, abs=0.03)


@pytest.mark.parametrize("parts", [1, 4, 100])
def test_a_run_that_equals_its_replications_is_inside(spark, parts):
    t = spark.createDataFrame([(1, k, "2020-01-01", 0.1 + (k % 7) / 10, 0.0) for k in range(997)], TRADES)
    same = spark.range(20).select(F.lit(1).cast("long").alias("run"), F.col("id").alias("replication")).crossJoin(t.select("r_net"))
    same = same.repartition(parts).groupBy("run", "replication").agg(R._mean(F.col("r_net")).alias("expectancy_r"))
    assert not R.envelope(t.repartition(parts), same).first()["outside"]


def test_forward_as_of(spark):
    rng = np.random.default_rng(6)
    left = [(k, "ab"[k % 2] if k % 10 else None, int(x)) for k, x in enumerate(rng.integers(-500, 5000, 400))]
    right = [("ab"[k % 2] if k % 5 else None, int(x)) for k, x in enumerate(rng.integers(0, 4000, 40))]
    a, b = spark.createDataFrame(left, "k long, g string, t long"), spark.createDataFrame(right, "g string, u long")
    for span in (1, 10, 700, 10**6):
        got = {r["k"]: r["found"] for r in FX.first_at_or_after(a, "t", b, "u", ["g"], "found", span).collect()}
        assert got == {k: min((u for h, u in right if h == g and u >= t), default=None) for k, g, t in left}


def test_drawdown_in_blocks(spark):
    rng = np.random.default_rng(8)
    runs = {1: rng.normal(size=500), 2: -np.ones(5), 3: np.ones(4), 4: np.array([0.5])}
    df = spark.createDataFrame([(g, k * 3, float(x)) for g, xs in runs.items() for k, x in enumerate(xs)], "run long, at long, r_net double")
    for blocks in (1, 2, 17, 1024):
        got = {r["run"]: r["max_drawdown_r"] for r in ST.summary(df, blocks).collect()}
        want = {g: max(0.0, float((np.maximum(np.maximum.accumulate(np.cumsum(xs)), 0) - np.cumsum(xs)).max())) for g, xs in runs.items()}
        assert got == pytest.approx(want)


def test_exits_in_crowded_minutes(spark):
    """Positions and ticks of a minute were paired: 1000 of each made a million rows."""
    from tidemark.operators.bars import resample, with_gaps

    ticks = spark.range(3000).select(F.lit("G").alias("instrument"), (M0 + F.col("id") * 60_000_000).alias("ts_utc_ns"), (1.0 + F.pmod(F.col("id") * 7919, F.lit(1009)) / 1000).alias("bid"), (1.001 + F.pmod(F.col("id") * 7919, F.lit(1009)) / 1000).alias("ask"), F.lit(None).cast("double").alias("bid_volume"), F.lit(None).cast("double").alias("ask_volume"), F.col("id").alias("row_sequence"))
    bars = with_gaps(resample(ticks), continuous=True)
    rows = [(f"p{k}", "G", "sell" if k % 2 else "buy", M0 + k * 60_000_000, 2.005 if k % 2 else 1.0, 0.9 if k % 2 else 2.0, M0 + 10**15, 0.0) for k in range(1000)]
    e = PO.exits(spark.createDataFrame(rows, PO.POSITIONS), bars, ticks)
    price = [1.0 + k * 7919 % 1009 / 1000 for k in range(3000)]
    for r in e.collect():
        k = int(r["position_id"][1:])
        at = next((i for i in range(k + 1, 3000) if (price[i] + 0.001 >= 2.005 if k % 2 else price[i] <= 1.0 or price[i] > 2.0)), None)
        assert r["exit_ns"] == (None if at is None else M0 + at * 60_000_000)
    t = ticks.withColumnRenamed("ts_utc_ns", "at").withColumn("minute", F.expr(T.minute_start("at")))
    near = spark.createDataFrame(rows, PO.POSITIONS).withColumn("minute", F.expr(T.minute_start("entry_ns")))
    assert PO._first_ticks(near, t)._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInPandas") == 1

"""Draws by whole arrays: against hashlib one by one, null and odd values too, and no row for each draw of a trade."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from tidemark.functions.draws import Digests
from tidemark.operators import robustness as R

SCHEMA = "run string, trade_id string, r_net double, r_opposite double, cost double"
ROWS = [("ab"[k % 2] if k % 31 else None, str(k * 7919) * (1 + 9 * (k % 13 == 0)) if k % 17 else None, (k % 23 - 9) / 8 if k % 11 else None, (9 - k % 23) / 8 if k % 19 else None, 0.25 * (k % 3)) for k in range(150)]


def number(seed, draw, trade, digits):
    text = f"{seed}:{draw}" + ("" if trade is None else f":{trade}")
    return [int(hashlib.md5(text.encode()).hexdigest()[i:j], 16) / 16 ** (j - i) for i, j in digits]


def poisson(u):
    total, k = math.exp(-1), 0
    while k < 12 and u >= total:
        k += 1
        total += math.exp(-1) / math.factorial(k)
    return k


def test_digests_are_md5():
    texts = [str(k * 37) for k in range(100)] + ["", "x" * 41, "y" * 42, "z" * 55, "ü" * 60, "q" * 300]
    d = Digests(pa.array(["cut off", *texts])[1:])
    for prefixes in ([b"7:0:"], [b"20260915:10:", b"20260915:99:", b"20260915:57:"], [b""], [b"a" * 70, b"b" * 70]):
        w = d.words(prefixes)
        for i, p in enumerate(prefixes):
            for j, t in enumerate(texts):
                h = hashlib.md5(p + t.encode()).hexdigest()
                assert w[:, i, j].tolist() == [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


@pytest.mark.parametrize("given_out,at_once", [(1 << 16, 1 << 14), (5, 100)])
def test_bounds_one_by_one(spark, monkeypatch, given_out, at_once):
    monkeypatch.setattr(R, "GIVEN_OUT", given_out), monkeypatch.setattr(R, "AT_ONCE", at_once)
    t = spark.createDataFrame(ROWS, SCHEMA)
    tests = {"x": (1.0, (1.0, 2.0)), "y": (0.5, (3.0,))}
    got = {(r["run"], r["test"], r["multiplier"]): (r["n"], r["low"]) for r in R.lower_bounds_of(t.coalesce(1), ["run"], 9, {k: (R.F.col("cost") * s, m) for k, (s, m) in tests.items()}, resamples=42).collect()}
    assert len(got) == 6  # a trade of no run has no bound
    for name, (share, multipliers) in tests.items():
        for m in multipliers:
            for run in "ab":
                means, of = [], [x for x in ROWS if x[0] == run]
                for b in range(42):
                    ws = [poisson(number(9, b // 4, x[1], [(8 * (b % 4), 8 * (b % 4) + 8)])[0]) for x in of]
                    r, c = (sum(w * round(v * 1e9) for w, v in zip(ws, vs) if v is not None) for vs in ([x[2] for x in of], [x[4] * share for x in of]))
                    means.append((r - (m - 1) * c) / 1e9 / sum(ws))
                assert got[run, name, m] == (len(of), pytest.approx(np.percentile(means, 2.5), abs=1e-12))


def test_placebo_one_by_one(spark):
    got = {(r["run"], r["replication"]): r["expectancy_r"] for r in R.placebo(spark.createDataFrame(ROWS, SCHEMA), 5, 12).collect()}
    assert len(got) == 36
    for (run, i), e in got.items():
        rs = [x[2] if number(5, i, x[1], [(0, 13)])[0] < 0.5 else x[3] for x in ROWS if x[0] == run]
        rs = [r for r in rs if r is not None]
        assert e == (pytest.approx(sum(rs) / len(rs), abs=1e-9) if rs else None)


def test_trades_of_one_piece_are_many_tasks(spark):
    """The digests of a file of one piece were the work of one task, with a row for each draw."""
    t = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    for df in (R.lower_bounds_of(t, ["run"], 9, {"x": (R.F.col("cost"), (1.0, 2.0)), "y": (R.F.col("cost"), (1.5,))}), R.placebo(t, 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "rangepartitioning(" in plan and "md5(" not in plan


def test_large_results_are_summed_whole(spark):
    t = spark.createDataFrame([("a", str(k), 4e7 + k, 0.0, 0.0) for k in range(100)], SCHEMA)  # 100 x 12 x 4e16 is more than 64 bits hold
    low = R.lower_bounds_of(t, ["run"], 9, {"x": (R.F.lit(0.0), (1.0,))}, resamples=8).first()["low"]
    assert 4e7 < low < 4e7 + 100

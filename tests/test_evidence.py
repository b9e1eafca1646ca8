"""Robustness tests, the classifier of forward records and gated reads, by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators import forward as V
from tidemark.operators import robustness as R
from tidemark.operators.events import HOLDOUT_NS, VaultError

TRADES = "run long, trade_id long, day date, side string, r_net double, r_opposite double, cost double"


def trades_of(spark, results):
    rows = [(1, k, f"{2010 + k % 5}-03-0{1 + k % 9}", "buy" if k % 2 else "sell", float(r), float(-r), 0.1) for k, r in enumerate(results)]
    return spark.createDataFrame(rows, "run long, trade_id long, day string, side string, r_net double, r_opposite double, cost double").withColumn("day", F.to_date("day"))


def test_years_and_best_trades(spark):
    t = trades_of(spark, [1.0] * 10)
    assert R.years_hold(R.by_year(t)).first()["passed"]
    uneven = trades_of(spark, [50.0, 1.0, 1.0, 1.0, 1.0])
    assert not R.years_hold(R.by_year(uneven)).first()["passed"]
    assert not R.years_hold(R.by_year(trades_of(spark, [-1.0] * 10))).first()["passed"]
    got = {r["share"]: (r["n"], r["expectancy_r"]) for r in R.without_best(trades_of(spark, [10.0, 5.0, *[0.0] * 98])).collect()}
    assert got[0.01] == (99, pytest.approx(5 / 99)) and got[0.05] == (95, 0.0) and got[0.1] == (90, 0.0)
    stress = {r["multiplier"]: r["expectancy_r"] for r in R.stressed(t, "cost", R.COSTS).collect()}
    assert stress == pytest.approx({1.0: 1.0, 1.5: 0.95, 2.0: 0.9, 3.0: 0.8})


def test_placebo_is_seeded_and_finds_an_edge(spark):
    edge = trades_of(spark, [1.0 if k % 10 < 8 else -1.0 for k in range(200)])
    first, again, other = (sorted((r["replication"], r["expectancy_r"]) for r in R.placebo(x, s).collect()) for x, s in ((edge, 1), (edge.repartition(7), 1), (edge, 2)))
    assert first == again != other and len(first) == 200
    assert R.envelope(edge, R.placebo(edge, 1)).first()["outside"]
    none = trades_of(spark, [1.0, -1.0] * 100)
    assert not R.envelope(none, R.placebo(none, 1)).first()["outside"]


def test_digests_and_readiness(spark):
    t = trades_of(spark, range(50))
    a, b = (R.digest(x, ["trade_id", "r_net"]).first()["result_sha256"] for x in (t, t.repartition(5)))
    c = R.digest(t.withColumn("r_net", F.when(F.col("trade_id") == 3, 0.0).otherwise(F.col("r_net"))), ["trade_id", "r_net"]).first()["result_sha256"]
    assert a == b != c
    assert R.ready(dict.fromkeys(R.MANDATORY, True)) == (True, ["RT-4", "RT-5", "RT-6", "RT-7", "RT-10", "RT-11"])
    assert not R.ready({"RT-1": True})[0]


def test_causes_in_their_order(spark):
    good = {"opportunity_id": "o", "noticed": True, "taken": True, "intended_risk_r": 1.0, "intended_entry": 1.2, "actual_entry": 1.2, "intended_stop": 1.1, "actual_stop": 1.1, "spread_at_fill": 0.001, "rule_violations": [], "actual_r": 0.5, "theoretical_r": 0.5}
    cases = [({"opportunity_id": None, "noticed": False}, "strategy"), ({"noticed": False, "taken": False}, "behavioural"), ({"taken": False, "intended_risk_r": 3.0}, "behavioural"), ({"intended_risk_r": 1.2, "actual_entry": 2.0}, "risk"), ({"actual_entry": 1.2002, "actual_stop": 1.0}, "execution"),
             ({"actual_stop": 1.1001, "rule_violations": ["x"]}, "risk"), ({"rule_violations": ["x"], "actual_r": 0.0}, "behavioural"), ({"actual_r": 0.4}, "execution"), ({"actual_r": 0.46}, "variance"), ({}, "variance"), ({"rule_violations": None}, "variance")]
    names = [f.split()[0] for f in V.RECORD.split(", ")]
    rows = spark.createDataFrame([tuple((good | c)[n] for n in names) for c, _ in cases], V.RECORD)
    assert [r["cause"] for r in V.reconcile(rows).collect()] == [w for _, w in cases]
    assert {r["cause"]: r["n"] for r in V.causes(rows).collect()} == {"strategy": 1, "behavioural": 3, "risk": 2, "execution": 2, "variance": 3}


def test_gated_reads(spark, tmp_path):
    told, root = [], str(tmp_path / "bars")
    reader = V.GatedReader(spark, root, "DEVELOPMENT", audit=told.append)
    assert reader.bars(0, V.DEVELOPMENT_END_NS).count() == 0
    with pytest.raises(VaultError):
        reader.bars(0, V.DEVELOPMENT_END_NS + 1)
    with pytest.raises(VaultError):
        V.GatedReader(spark, root, "DESCRIPTIVE_PRE_VAULT", audit=told.append).bars(0, HOLDOUT_NS + T.HOUR)
    for kind in ("HOLDOUT", "VALIDATION", "ANYTHING"):
        with pytest.raises(VaultError):
            V.GatedReader(spark, root, kind, "F-001", audit=told.append)
    assert V.GatedReader(spark, root, "HOLDOUT", "F-001", unlocked=frozenset(["F-001"])).bars(0, HOLDOUT_NS + T.HOUR).count() == 0
    assert V.GatedReader(spark, root, "VALIDATION", "F-001", registered=frozenset(["F-001"])).bars(0, HOLDOUT_NS).count() == 0
    assert sum(t["what"].startswith("violation") for t in told) == 5 and sum(t["what"] == "reader" for t in told) == 5

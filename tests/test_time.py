"""Clocks, trading days, sessions."""

from datetime import UTC, date, datetime
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators.sessions import days_between, membership, session_windows, validate_sessions
from tidemark.plans.config import FX_CORE, ConfigError, Period, Periods, Session, SessionSet, load_session_set


def ns(*args, zone="UTC"):
    return T.utc_ns(datetime(*args, tzinfo=ZoneInfo(zone)))


@pytest.mark.parametrize(
    ("wall", "zone", "policy", "utc"),
    [
        ((2021, 3, 14, 2, 30), T.NEW_YORK, "later", (2021, 3, 14, 7, 0)),
        ((2021, 11, 7, 1, 30), T.NEW_YORK, "later", (2021, 11, 7, 6, 30)),
        ((2021, 11, 7, 1, 30), T.NEW_YORK, "earlier", (2021, 11, 7, 5, 30)),
        ((2023, 3, 26, 1, 30), T.LONDON, "later", (2023, 3, 26, 1, 0)),
        ((2006, 4, 2, 12, 0), T.NEW_YORK, "raise", (2006, 4, 2, 16, 0)),
        ((2007, 3, 11, 12, 0), T.NEW_YORK, "raise", (2007, 3, 11, 16, 0)),
        ((2023, 7, 1, 9, 0), T.TOKYO, "raise", (2023, 7, 1, 0, 0)),
    ],
)
def test_resolve(spark, wall, zone, policy, utc):
    assert T.local_to_ns(datetime(*wall), zone, policy) == ns(*utc)
    df = spark.createDataFrame([(ns(*wall),)], "w long")
    assert T.resolve_local(df, "w", zone, "u", policy).first()["u"] == ns(*utc)


def test_resolve_gap_earlier_and_raise(spark):
    gap = datetime(2021, 3, 14, 2, 30)
    assert T.local_to_ns(gap, T.NEW_YORK, "earlier") == ns(2021, 3, 14, 7) - 1
    df = spark.createDataFrame([(ns(2021, 3, 14, 2, 30),)], "w long")
    assert T.resolve_local(df, "w", T.NEW_YORK, "u", "earlier").first()["u"] == ns(2021, 3, 14, 7) - 1
    with pytest.raises(T.AmbiguousTimeError):
        T.local_to_ns(gap, T.NEW_YORK, "raise")
    with pytest.raises(Exception, match="not a unique time"):
        T.resolve_local(df, "w", T.NEW_YORK, "u", "raise").collect()


def test_trading_days(spark):
    points = {
        ns(2023, 6, 4, 17, zone=T.NEW_YORK): "2023-06-05", ns(2023, 6, 9, 17, zone=T.NEW_YORK): "2023-06-10", ns(2023, 6, 9, 17, zone=T.NEW_YORK) - 1: "2023-06-09",
        ns(2023, 3, 10, 22): "2023-03-11", ns(2023, 3, 13, 21): "2023-03-14", ns(2023, 3, 13, 20, 59): "2023-03-13",
    }
    df = spark.createDataFrame([(k,) for k in points], "t long").withColumn("d", F.expr(T.trading_day("t")).cast("string"))
    assert {r["t"]: r["d"] for r in df.collect()} == points
    weeks = spark.createDataFrame([(date(2020, 12, 28),), (date(2021, 1, 1),), (date(2021, 1, 2),), (date(2021, 1, 4),)], "d date").withColumn("w", F.expr(T.trading_week("d")))
    assert [r["w"] for r in weeks.orderBy("d").collect()] == ["2020-W53", "2020-W53", "2021-W01", "2021-W01"]


def test_weekend_gap(spark):
    points = {ns(2023, 6, 9, 17, zone=T.NEW_YORK): True, ns(2023, 6, 9, 17, zone=T.NEW_YORK) - 1: False, ns(2023, 6, 11, 17, zone=T.NEW_YORK): False, ns(2023, 6, 11, 16, 59, zone=T.NEW_YORK): True}
    df = spark.createDataFrame([(k,) for k in points], "t long").withColumn("g", F.expr(T.weekend_gap("t")))
    assert {r["t"]: r["g"] for r in df.collect()} == points


def test_session_windows(spark):
    w = {(str(r["day"]), r["session"]): r for r in session_windows(days_between(spark, "2023-01-15", "2023-06-15")).collect()}
    assert (w["2023-06-15", "pre_london"]["start_ns"], w["2023-06-15", "pre_london"]["end_ns"]) == (ns(2023, 6, 14, 23), ns(2023, 6, 15, 7))
    assert (w["2023-01-15", "pre_london"]["start_ns"], w["2023-01-15", "pre_london"]["end_ns"]) == (ns(2023, 1, 15), ns(2023, 1, 15, 8))
    assert w["2023-06-05", "new_york"]["end_ns"] == ns(2023, 6, 5, 17, zone=T.NEW_YORK)
    # between the two changes of March London is four hours from New York
    assert w["2023-03-15", "overlap_london_ny"]["start_ns"] == ns(2023, 3, 15, 12) and w["2023-03-15", "london"]["start_ns"] == ns(2023, 3, 15, 4, zone=T.NEW_YORK)
    assert w["2023-01-15", "london"]["partial"] and not w["2023-01-16", "london"]["partial"]
    assert validate_sessions(spark, start="2019-01-01", end="2021-12-31").count() == 0


def test_membership(spark):
    at = ns(2023, 6, 15, 13)
    rows = membership(spark.createDataFrame([(at,), (ns(2023, 6, 15, 21, 30),)], "ts_utc_ns long"), session_windows(days_between(spark, "2023-06-14", "2023-06-17")))
    assert {r["ts_utc_ns"]: r["sessions"] for r in rows.collect()} == {at: ["london", "new_york", "overlap_london_ny"], ns(2023, 6, 15, 21, 30): []}


def test_config(tmp_path):
    for bad in (Session("x", "Nowhere/At_all", "08:00", "09:00"), Session("x", T.LONDON, "09:00", "08:00"), Session("x", T.LONDON, "9:00", "10:00"), Session("x", parents=("london",)), Session("x", parents=("london", "none"))):
        with pytest.raises(ConfigError):
            SessionSet("s", (FX_CORE["london"], bad))
    with pytest.raises(ConfigError):
        Periods((Period("a", date(2007, 1, 1), date(2007, 12, 31)), Period("b", date(2008, 1, 2), None)))
    f = tmp_path / "s.yaml"
    f.write_text("name: s\nversion: 1\nfold_policy: {nonexistent: later, ambiguous: later}\nsessions:\n  a: {tz: Europe/London, start: '08:00', end: '11:00'}\n  b: {tz: America/New_York, start: '04:00', end: '05:00'}\n  c: {intersection_of: [a, b]}\n")
    assert load_session_set(f)["c"].parents == ("a", "b")


@settings(max_examples=200, deadline=None)
@given(st.integers(min_value=1_200_000_000, max_value=1_700_000_000), st.sampled_from([T.NEW_YORK, T.LONDON, T.TOKYO]))
def test_round_trip(second, zone):
    wall = datetime.fromtimestamp(second, UTC).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    assert second * 10**9 in (T.local_to_ns(wall, zone, "later"), T.local_to_ns(wall, zone, "earlier"))

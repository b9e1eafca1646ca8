"""Month files, hour files, logs, reports."""

import lzma
import struct
import zipfile
from datetime import UTC, datetime

import numpy as np
import pytest

from tidemark import cli, report
from tidemark.functions import canonical as C
from tidemark.functions.timex import HOUR, MINUTE
from tidemark.operators import ingest as I
from tidemark.sources.ticks import IntegrityError
from tidemark.streaming.bars import stream_counts


def wall(*args):
    return int((datetime(*args) - datetime(1970, 1, 1)).total_seconds()) * 10**9


def line(ns, a, b):
    at = datetime(1970, 1, 1) + np.timedelta64(ns // 1000, "us").astype("timedelta64[us]").item()
    return f"{at:%Y%m%d %H%M%S}{at.microsecond // 1000:03d},{a:.5f},{b:.5f},0"


def month(start, n=200, step=MINUTE, swap=lambda k: False):
    return "\n".join(line(start + k * step, *((1.3002, 1.3) if swap(k) else (1.3, 1.3002))) for k in range(n)) + "\n"


def test_plain_month():
    t, how = I.parse_month(month(wall(2017, 5, 1, 9)), 2017, 5)
    assert len(t) == 200 and t["ts_utc_ns"][0] == wall(2017, 5, 1, 13) and how["column_order"].endswith("bid_ask") and (t["ask"] > t["bid"]).all()
    t, how = I.parse_month(month(wall(2017, 5, 1, 9), swap=lambda k: True), 2017, 5)
    assert how["column_order"].endswith("ask_bid") and (t["ask"] > t["bid"]).all()


def test_column_change_over_a_weekend():
    friday, sunday = wall(2009, 5, 15, 12), wall(2009, 5, 17, 18)
    text = month(friday, 100) + month(sunday, 100, swap=lambda k: True)
    t, how = I.parse_month(text, 2009, 5)
    assert "weekend" in how["column_order"] and (t["ask"] > t["bid"]).all()
    with pytest.raises(IntegrityError, match="no weekend"):
        I.parse_month(month(wall(2009, 5, 12, 12), 100) + month(wall(2009, 5, 13, 12), 100, swap=lambda k: True), 2009, 5)
    with pytest.raises(IntegrityError, match="within the day"):
        I.parse_month(month(wall(2009, 5, 12, 12), 100, swap=lambda k: k % 2), 2009, 5)


@pytest.mark.parametrize(("text", "said"), [("", "empty"), ("20170501 090000000,1.3,1.4\n", "four fields"), ("20170501 090000000,1.3,x,0\n", "line 1"), (month(wall(2017, 5, 1, 9), 3) + "2017-05-01 09:00,1,2,0\n", "line 4"), (month(wall(2017, 6, 1, 9), 3), "not of 2017-05"), ("20170501 090000000,1.4,1.3,0\n" * 1 + month(wall(2017, 5, 1, 10), 150), "bid above ask")])
def test_bad_months(text, said):
    with pytest.raises(IntegrityError, match=said):
        I.parse_month(text, 2017, 5)


def test_equal_quotes_are_allowed():
    t, _ = I.parse_month("20170501 090000000,1.3,1.3,0\n" + month(wall(2017, 5, 1, 10), 150), 2017, 5)
    assert len(t) == 151


def test_clock_by_weekend_edges():
    us = np.array([wall(2018, 3, 16, 16, 59), wall(2018, 3, 18, 17, 1)])
    eu = np.array([wall(2022, 3, 18, 15, 59), wall(2022, 3, 20, 16, 1)])
    assert I.stamp_clock(us, 2018, 3)[0] == "us_dst" and I.stamp_clock(eu, 2022, 3)[0] == "eu_dst"
    assert I.stamp_clock(np.array([wall(2018, 6, 1, 9), wall(2018, 6, 1, 10)]), 2018, 6)[0] is None
    with pytest.raises(IntegrityError, match="two clocks"):
        I.stamp_clock(np.array([wall(2018, 3, 16, 16, 59), wall(2018, 3, 18, 16, 1)]), 2018, 3)
    with pytest.raises(IntegrityError, match="nothing that tells"):
        I.stamp_clock(np.array([wall(2018, 3, 14, 9), wall(2018, 3, 14, 10)]), 2018, 3)


def test_autumn_change_by_file_position():
    """2022: London changes on 30 October; the clock steps back at 00:00 UTC of the Monday, 20:00 to 19:00."""
    before = np.arange(wall(2022, 10, 30, 17), wall(2022, 10, 30, 20), MINUTE)
    after = np.arange(wall(2022, 10, 30, 19), wall(2022, 10, 30, 22), MINUTE)
    stamps = np.concatenate([before, after])
    clock, _ = I.stamp_clock(stamps, 2022, 10)
    assert clock == "eu_dst"
    I.check_order(stamps, clock, 2022, 10)
    utc = I.to_utc(stamps, clock, 2022, 10)
    assert (np.diff(utc) == MINUTE).all() and utc[0] == wall(2022, 10, 30, 21)
    with pytest.raises(IntegrityError, match="step back"):
        I.check_order(stamps - 7 * HOUR, clock, 2022, 10)


def test_spring_change_of_both_clocks():
    stamps = np.concatenate([np.arange(wall(2022, 3, 27, 17), wall(2022, 3, 27, 19), MINUTE), np.arange(wall(2022, 3, 27, 20), wall(2022, 3, 27, 22), MINUTE)])
    assert I.stamp_clock(stamps, 2022, 3)[0] == "eu_dst"
    assert (np.diff(I.to_utc(stamps, "eu_dst", 2022, 3)) == MINUTE).all()
    straight = np.arange(wall(2018, 3, 25, 17), wall(2018, 3, 25, 22), MINUTE)
    assert I.stamp_clock(straight, 2018, 3)[0] == "us_dst"


def test_new_york_transition_day():
    assert I.to_utc(np.array([wall(2018, 11, 4, 0, 30), wall(2018, 11, 4, 1, 30), wall(2018, 11, 4, 3)]), "us_dst", 2018, 11).tolist() == [wall(2018, 11, 4, 4, 30), wall(2018, 11, 4, 6, 30), wall(2018, 11, 4, 8)]


def test_files_through_spark(spark, tmp_path):
    name = "DAT_ASCII_GBPUSD_T_201705.csv"
    (tmp_path / name).write_text(month(wall(2017, 5, 1, 9)))
    (tmp_path / "DAT_ASCII_GBPUSD_T_201706.csv").write_text(month(wall(2017, 6, 1, 9), 50))
    (tmp_path / "DAT_ASCII_GBPUSD_T_201705.txt").write_text("File Status\nGap of 61s found between a and b\nGap of 120s found between b and c\nno gap\n")
    got = I.read_month_files(spark, str(tmp_path))
    assert {(r["instrument"], r["year"], r["month"]): r["n"] for r in got.groupBy("instrument", "year", "month").agg(I.F.count("*").alias("n")).collect()} == {("GBPUSD", 2017, 5): 200, ("GBPUSD", 2017, 6): 50}
    assert [r["n_gaps"] for r in I.gap_reports(spark, str(tmp_path)).collect()] == [2]
    inner = tmp_path / "HISTDATA_COM_ASCII_GBPUSD_T201705.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.write(tmp_path / name, name)
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.write(inner, inner.name)
    assert [p.name for p in I.month_files(tmp_path / "all.zip", tmp_path / "s1")] == [name]
    assert I.month_files(tmp_path / "all.zip", tmp_path / "s2", skip={("GBPUSD", 2017, 5)}) == []
    assert [p.name for p in I.month_files(tmp_path, tmp_path / "s3", ["GBPUSD"])] == [name]


def test_hours(spark, tmp_path):
    raw = struct.pack(">IIIff", 250, 130010, 130000, 1.5, 2.5) + struct.pack(">IIIff", 3_000, 130020, 130001, 0.5, 1.0)
    t = I.parse_hour(lzma.compress(raw), 10**18)
    assert t["ts_utc_ns"].tolist() == [10**18 + 250 * 10**6, 10**18 + 3 * 10**9] and t["ask"][0] == pytest.approx(1.3001) and t["bid_volume"][0] == 2.5
    assert len(I.parse_hour(b"", 0)) == 0
    for bad in (lzma.compress(raw[:-1]), b"nothing"):
        with pytest.raises(IntegrityError):
            I.parse_hour(bad, 0)
    at = datetime(2020, 1, 2, 3, tzinfo=UTC)
    for k, blob in enumerate((lzma.compress(raw), b"junk")):
        f = tmp_path / I.hour_path("", "GBPUSD", at.replace(hour=3 + k)).lstrip("/")
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(blob)
    rows = I.read_hours(spark, str(tmp_path)).collect()
    assert sum(r["error"] is None for r in rows) == 2 and sum(r["error"] is not None for r in rows) == 1
    assert I.hour_url("GBPUSD", at).endswith("GBPUSD/2020/00/02/03h_ticks.bi5") and "/01/02/" in I.hour_path("d", "GBPUSD", at)
    with pytest.raises(ValueError):
        I.hour_url("GBPUSD", at.replace(minute=1))


def test_fetch_status():
    assert I.fetch_status(200, 5, 1) == ("fetched", None) and I.fetch_status(200, 0, 1)[0] == I.fetch_status(404, 0, 1)[0] == "empty"
    assert I.fetch_status(429, 0, 1) == ("rate_limited", 60.0) and I.fetch_status(429, 0, 9)[1] == 900.0 and I.fetch_status(429, 0, 1, "7")[1] == 7.0
    assert I.fetch_status(500, 0, 3) == ("failed", 4.0)


def test_calendar(spark):
    make = lambda rows: spark.createDataFrame(rows, "date string, event_type string").selectExpr("cast(date as date) as date", "event_type")
    got = I.release_calendar(make([("2020-01-10", "nfp"), ("2020-01-10", "fomc"), ("2020-01-10", "nfp")])).collect()
    assert got[0]["event_types"] == ["fomc", "nfp"]
    for bad in ([("2020-01-10", "other")], [(None, "nfp")], [("2020-01-10", None)]):
        with pytest.raises(Exception, match="not a scheduled release"):
            I.release_calendar(make(bad)).collect()


def test_canonical():
    assert C.canonical_json({"b": 1, "a": [1.5, None, "é"]}) == '{"a":[1.5,null,"é"],"b":1}'
    for bad in (float("nan"), {1: 2}, {"a": {3}}):
        with pytest.raises(C.HashingError):
            C.canonical_json(bad)
    assert C.new_ulid(1) < C.new_ulid(2) and len(C.new_ulid()) == 26
    assert C.sequential_id("H", ["H-001", "H-0007"]) == "H-008" and C.sequential_id("H", []) == "H-001" and C.sequential_id("H", ["H-999"]) == "H-1000"
    assert C.new_id("RUN")[:4] == "RUN-" and len(C.new_id("RUN")) == 30


def test_logs_and_reports(spark, tmp_path):
    log = tmp_path / "l.json"
    assert report.read_log(log) is None
    report.record_widening(log, {"n": 1, "widened_from": None})
    report.record_widening(log, {"n": 2, "widened_from": "range_pct_max"})
    with pytest.raises(report.LogError):
        report.record_widening(log, {"n": 3, "widened_from": "range_pct_max"})
    for bad in ("{", "[]", '{"schema_version": 9, "entries": []}'):
        log.write_text(bad)
        with pytest.raises(report.LogError):
            report.read_log(log)
    from pyspark.sql import Row

    text = report.cells([Row(n=9, x=1.0), Row(n=20, x=2.0), Row(n=30, x=3.0)], ["n", "x"], ["x"])
    assert "| 9 | - | suppressed |" in text and "small sample" in text and "| 30 | 3.000000 |  |" in text
    svg = report.box_plot([("a <b>", [{"label": 1, "low": 0.0, "q1": 1.0, "median": 2.0, "q3": 3.0, "high": 4.0, "outliers": [9.0]}])])
    assert svg.startswith("<svg") and "&lt;b&gt;" in svg and svg.count("<rect") == 1


def test_command_line_refuses(capsys):
    assert cli.main(["validate", "--data", "x", "--start", "2022-01-01T00:00:00Z", "--end", "2023-01-01T01:00:00Z"]) == 1
    assert cli.main(["validate", "--data", "x", "--start", "2022-01-01T00:30:00Z"]) == 1
    assert cli.parse_month("2020-03") == (2020, 3)


def test_command_line_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "src").mkdir()
    (tmp_path / "src/DAT_ASCII_GBPUSD_T_201006.csv").write_text(month(wall(2010, 6, 1, 9), 3000, 7 * MINUTE))
    base = ["--data", str(tmp_path / "d"), "--out", str(tmp_path / "r"), "--start", "2010-06-01T00:00:00Z", "--end", "2010-07-01T00:00:00Z"]
    assert cli.main(["import", *base, "--source", str(tmp_path / "src"), "--staging", str(tmp_path / "s")]) == 0
    assert cli.main(["resample", *base]) == 0
    assert cli.main(["resample", *base[:-1], "2010-09-01T00:00:00Z"]) == 2
    assert cli.main(["features", *base, "--name", "pre_london_high"]) == 0
    assert cli.main(["describe", *base, "--report", "R5"]) == 0
    assert "suppressed" in (tmp_path / "r/r5.md").read_text() or "small sample" in (tmp_path / "r/r5.md").read_text()
    assert cli.main(["validate", *base]) == 0
    assert cli.main(["probe", *base]) == 3


def test_stream_counts_like_batch(spark, tmp_path):
    rows = [("G", wall(2024, 1, 8, 10) + k * 40 * 10**9, 1.0, 1.0 + (k % 2), k) for k in range(300)]
    df = spark.createDataFrame(rows, "instrument string, ts_utc_ns long, bid double, ask double, row_sequence long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "1 minute").writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["start"].hour: (r["n_ticks"], r["n_zero_spread"]) for r in spark.table("counted").collect()}
    assert got == {10: (90, 45), 11: (90, 45), 12: (90, 45)}

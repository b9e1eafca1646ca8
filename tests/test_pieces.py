"""Month files in pieces read as they do whole, and the queries' files are in pieces of bounded size."""

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_repeated import repeated  # noqa: F401
from tidemark.functions.timex import HOUR, MINUTE, NEW_YORK, local_to_ns
from tidemark.operators import ingest as I
from tidemark.queries import ingestion as Q
from tidemark.sources.ticks import IntegrityError

NAME = "DAT_ASCII_EURUSD_T_{}.csv"


def month(first, last, offsets, change=None):
    """Lines of every three minutes but weekends, stamped at offsets[0] hours until instants of offsets[1], and so on."""
    ns = lambda *x: int((datetime(*x) - datetime(1970, 1, 1)).total_seconds()) * 10**9
    lines = []
    for at in range(ns(*first), ns(*last), 3 * MINUTE):
        shift = next(h for h, until in offsets if until is None or at < ns(*until))
        stamp = datetime(1970, 1, 1) + timedelta(microseconds=(at + shift * HOUR) // 1000)
        winter = datetime(1970, 1, 1) + timedelta(microseconds=(at - 5 * HOUR) // 1000)
        if winter.weekday() == 5 or winter.weekday() == 4 and winter.hour >= 16 or winter.weekday() == 6 and winter.hour < 16:
            continue
        a, b = ("1.100010", "1.100000") if change and stamp.day >= change else ("1.100000", "1.100010")
        lines.append(f"{stamp:%Y%m%d %H%M%S}000,{a},{b},0")
    return lines


CASES = {
    "201803": ((2018, 3, 1, 5), (2018, 4, 1, 3), [(-5, (2018, 3, 11, 7)), (-4, None)], None),
    "202203": ((2022, 3, 1, 5), (2022, 4, 1, 3), [(-5, (2022, 3, 28)), (-4, None)], 12),
    "202210": ((2022, 10, 2, 20), (2022, 11, 1, 4), [(-4, (2022, 10, 31)), (-5, None)], 8),
}


def pieces_of(lines, size):
    return [(k, "\n".join(lines[at : at + size]).encode()) for k, at in enumerate(range(0, len(lines), size))]


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("size", [397, 3000])
def test_pieces_read_as_the_whole_file(spark, name, size):
    lines = month(*CASES[name])
    path = NAME.format(name)
    whole = spark.createDataFrame([(path, "\n".join(lines).encode())], "path string, content binary")
    parts = spark.createDataFrame([(path, k, x) for k, x in reversed(pieces_of(lines, size))], "path string, part long, content binary").repartition(3)
    assert sorted(map(str, I.month_ticks(parts).collect())) == sorted(map(str, I.month_ticks(whole).collect()))
    assert I.month_readings(parts).collect() == I.month_readings(whole).collect()


def test_a_bad_line_is_named_by_its_place_in_the_file(spark):
    lines = month(*CASES["201803"])
    lines[1234] = lines[1234][:-2]
    parts = spark.createDataFrame([(NAME.format("201803"), k, x) for k, x in pieces_of(lines, 500)], "path string, part long, content binary")
    with pytest.raises(Exception, match="201803.csv: line 1235: four fields are needed"):
        I.month_ticks(parts).collect()
    twice = spark.createDataFrame([(NAME.format("201803"), 0, x) for _, x in pieces_of(lines, 500)], "path string, part long, content binary")
    with pytest.raises(Exception, match="two pieces of one number"):
        I.month_ticks(twice).collect()


def test_step_back_between_pieces(spark):
    lines = month(*CASES["201803"])
    lines[499], lines[500] = lines[500], lines[499]
    with pytest.raises(IntegrityError, match="step back 1 times, first at line 501"):
        I._plan([I._summary(x, 2018, 3) for _, x in pieces_of(lines, 500)], 2018, 3)


@pytest.mark.parametrize("day", [(2024, 3, 10), (2018, 11, 4), (2024, 3, 12)])
def test_many_stamps_of_a_day_of_clock_change(day, monkeypatch):
    calls = []
    real = I.transitions
    monkeypatch.setattr(I, "transitions", lambda *x: calls.append(x) or real(*x))
    midnight = datetime(*day)
    walls = [midnight + timedelta(minutes=5 * k) for k in range(288)]
    stamps = np.array([int((w - datetime(1970, 1, 1)).total_seconds()) * 10**9 for w in walls])
    assert I.to_utc(stamps, "us_dst", *day[:2]).tolist() == [local_to_ns(w, NEW_YORK, "later") for w in walls]
    assert len(calls) < 10  # the offsets are looked up for the day, not for each stamp


def test_no_row_of_the_queries_holds_a_whole_file(spark, repeated, monkeypatch):  # noqa: F811
    monkeypatch.setattr(Q, "PIECE", 7)
    files = Q._files(Q._clock_lines(spark, str(repeated[0]))).collect()
    n = [x["content"].count(b"\n") + 1 for x in files]
    assert max(n) == 7 and sum(n) == Q._clock_lines(spark, str(repeated[0])).count()
    assert len({(x["path"], x["part"]) for x in files}) == len(files)


@pytest.mark.parametrize("read", [I.month_plans, I.month_ticks])
def test_no_batch_of_a_worker_holds_many_pieces(spark, tmp_path, monkeypatch, read):
    text = F.encode(F.repeat(F.lit("20240305 100000000,1.100000,1.100010,0\n"), 26_000), "utf-8")  # 1 MB
    pieces = spark.range(0, 40, 1, 1).select(F.lit(NAME.format("202403")).alias("path"), F.col("id").alias("part"), text.alias("content"))
    real = type(pieces).mapInPandas

    def noted(self, func, schema):
        def run(batches):
            def sizes():
                for pdf in batches:
                    with open(f"{tmp_path}/{os.getpid()}", "a") as f:
                        f.write(f"{sum(len(x) for c in pdf for x in pdf[c] if isinstance(x, bytes))}\n")
                    yield pdf

            return func(sizes())

        return real(self, run, schema)

    monkeypatch.setattr(type(pieces), "mapInPandas", noted)
    assert read(pieces).count() == (40 if read is I.month_plans else 40 * 26_000)
    sizes = [int(x) for p in tmp_path.iterdir() for x in p.read_text().split()]
    assert sum(sizes) >= 40 * 1_000_000 and max(sizes) <= 10_000_000


def test_pieces_come_whole_out_of_their_slices(spark):
    contents = [b"", b"x", bytes(range(250)) * 4, bytes(range(250)) * 4 + b"y", b"z" * 12_345]
    pieces = spark.createDataFrame([("p", k, x) for k, x in enumerate(contents)], "path string, part long, content binary").coalesce(1)
    rows = I._sliced(pieces.withColumn("more", F.array("part"))).toPandas()
    assert max(map(len, rows["slice"])) == I.SLICE
    for cut in (1, 4, len(rows)):  # batches may end anywhere
        got = [(x.part, list(x.more), content) for x, content in I._whole(rows[at : at + cut] for at in range(0, len(rows), cut))]
        assert got == [(k, [k], x) for k, x in enumerate(contents)]
    with pytest.raises(IntegrityError, match="out of order"):
        list(I._whole([rows[::-1]]))
    with pytest.raises(Exception, match="p: no content"):
        I.month_plans(spark.createDataFrame([("p", 0, None)], "path string, part long, content binary")).collect()

"""Upserts of versioned tables: whole or not at all, with writers that die and writers that race."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources.ticks import IntegrityError
from tidemark.sources.versions import VersionedTable

JANUARY, MONTH = 1_704_067_200_000_000_000, 31 * 86_400_000_000_000


def ticks_of(spark, rows):
    schema = "instrument string, ts_utc_ns long, bid double, ask double, bid_volume double, ask_volume double, row_sequence long"
    return spark.createDataFrame([("G", JANUARY + m * MONTH + k, float(b), b + 0.5, None, None, k) for m, k, b in rows], schema)


def held(table, version=None):
    return sorted((r["month"], r["row_sequence"], r["bid"]) for r in table.read(version).collect())


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable.of_ticks(spark, str(tmp_path / "t"))


def test_versions(spark, table):
    assert held(table) == [] and table.versions() == []
    assert table.upsert(ticks_of(spark, [(0, 1, 1.0), (0, 2, 2.0), (1, 1, 5.0)])) == 1
    assert table.upsert(ticks_of(spark, [(0, 2, 9.0), (0, 3, 3.0)])) == 2
    assert held(table) == [(1, 1, 1.0), (1, 2, 9.0), (1, 3, 3.0), (2, 1, 5.0)] and held(table, 1) == [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 5.0)]
    assert table.upsert(ticks_of(spark, [])) == 2
    with pytest.raises(IntegrityError):
        table.read(7)
    assert len(table.vacuum(keep=1)) == 0 and table.versions() == [2] and held(table) == [(1, 1, 1.0), (1, 2, 9.0), (1, 3, 3.0), (2, 1, 5.0)]
    table.upsert(ticks_of(spark, [(0, 1, 0.0), (1, 1, 0.0)]))
    assert len(table.vacuum(keep=1)) == 2 and held(table) == [(1, 1, 0.0), (1, 2, 9.0), (1, 3, 3.0), (2, 1, 0.0)]


def test_a_writer_that_dies_leaves_nothing(spark, table, monkeypatch):
    table.upsert(ticks_of(spark, [(0, 1, 1.0)]))
    before = held(table)
    monkeypatch.setattr(table, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        table.upsert(ticks_of(spark, [(0, 1, 7.0), (1, 1, 7.0)]))
    monkeypatch.undo()
    assert held(table) == before and table.versions() == [1]
    assert len(table.vacuum()) == 1 and held(table) == before


def test_a_version_is_published_once(spark, table):
    assert table._publish(1, {("G", 2024, 1): "a"}) and not table._publish(1, {("G", 2024, 1): "b"})
    assert table.months() == {("G", 2024, 1): "a"}


def test_the_second_of_two_writers_builds_on_the_first(spark, table, monkeypatch):
    table.upsert(ticks_of(spark, [(0, 1, 1.0), (1, 1, 1.0)]))
    other, publish, merges = VersionedTable.of_ticks(spark, table.root), table._publish, []
    merged = table._merged
    monkeypatch.setattr(table, "_merged", lambda *a: merges.append(1) or merged(*a))
    for rows, theirs, n in (([(0, 2, 2.0)], [(0, 3, 3.0)], 2), ([(0, 4, 4.0)], [(1, 9, 9.0)], 1)):  # of the same month, and of another

        def late(version, months, theirs=theirs):
            monkeypatch.setattr(table, "_publish", publish)
            other.upsert(ticks_of(spark, theirs))
            return publish(version, months)

        monkeypatch.setattr(table, "_publish", late)
        merges.clear()
        table.upsert(ticks_of(spark, rows))
        assert len(merges) == n
    assert held(table) == [(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0), (1, 4, 4.0), (2, 1, 1.0), (2, 9, 9.0)] and table.versions() == [1, 2, 3, 4, 5]


def test_racing_writers(spark, table):
    writers = [threading.Thread(target=VersionedTable.of_ticks(spark, table.root).upsert, args=(ticks_of(spark, [(k % 2, 10 + k, float(k))]),)) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert held(table) == sorted((1 + k % 2, 10 + k, float(k)) for k in range(4)) and table.versions() == [1, 2, 3, 4]
    assert table.read().where(F.col("instrument") == "G").count() == 4

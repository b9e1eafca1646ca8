"""Quote ticks and one-minute bars as partitioned Parquet; months expected, present and missing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import timex as T

TICKS = "ts_utc_ns long, bid double, ask double, bid_volume double, ask_volume double, row_sequence long"
BARS = (
    "ts_utc_ns long, bid_o double, bid_h double, bid_l double, bid_c double, ask_o double, ask_h double, ask_l double, ask_c double, tick_count int, "
    "first_tick_ns long, last_tick_ns long, spread_open double, spread_max double, spread_twa double, prev_gap_ns long"
)
PARTITIONS = "instrument string, year int, month int"
ZSTD = {"compression": "zstd", "parquet.compression.codec.zstd.level": "3"}


class IntegrityError(RuntimeError):
    """Stored data that is incomplete or contradicts itself."""


def with_month(rows: DataFrame, ts: str = "ts_utc_ns") -> DataFrame:
    """Adds the partition columns year and month (UTC)."""
    return rows.withColumn("year", F.expr(T.utc_year(ts))).withColumn("month", F.expr(f"month({T.instant(ts)})"))


def scan(spark: SparkSession, root: str, schema: str, start_ns: int | None = None, end_ns: int | None = None, instruments: list[str] | None = None) -> DataFrame:
    """Rows of [start, end) of a table partitioned by instrument, year and month. The range is also put as years and months, so that
    other partitions are not listed into the plan; a root that doesn't exist is an empty table."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], f"{schema}, {PARTITIONS}")
    rows = spark.read.schema(f"{schema}, {PARTITIONS}").parquet(root)
    if instruments is not None:
        rows = rows.where(F.col("instrument").isin(instruments))
    for ns, compare in ((start_ns, ">="), (None if end_ns is None else end_ns - 1, "<=")):
        if ns is not None:
            y, m = spark.sql(f"select year({T.instant(str(ns))}), month({T.instant(str(ns))})").first()
            rows = rows.where(f"ts_utc_ns {compare} {ns} and (year {compare[0]} {y} or (year = {y} and month {compare} {m}))")
    return rows


def read_ticks(spark: SparkSession, root: str, start_ns: int | None = None, end_ns: int | None = None, instruments: list[str] | None = None) -> DataFrame:
    return scan(spark, root, TICKS, start_ns, end_ns, instruments)


def read_bars(spark: SparkSession, root: str, start_ns: int | None = None, end_ns: int | None = None, instruments: list[str] | None = None) -> DataFrame:
    return scan(spark, root, BARS, start_ns, end_ns, instruments).orderBy("instrument", "ts_utc_ns")


def months_covering(spark: SparkSession, start_ns: int, end_ns: int) -> DataFrame:
    """(year, month) of every month that [start, end) touches."""
    if end_ns <= start_ns:
        return spark.createDataFrame([], "year int, month int")
    return spark.sql(f"select year(d) as year, month(d) as month from (select explode(sequence(trunc({T.instant(str(start_ns))}, 'MM'), trunc({T.instant(str(end_ns - 1))}, 'MM'), interval 1 month)) as d)")


def months_of(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Adds (year, month) of every month that a row's own [start, end) touches, a row for each; none if that is empty."""
    first, last = (f"trunc({T.instant(x)}, 'MM')" for x in (start, f"({end} - 1)"))
    each = rows.where(f"{start} < {end}").withColumn("_month", F.explode(F.expr(f"sequence({first}, {last}, interval 1 month)")))
    return each.withColumns({"year": F.year("_month"), "month": F.month("_month")}).drop("_month")


def missing_months(spark: SparkSession, rows: DataFrame, start_ns: int, end_ns: int, instruments: list[str]) -> DataFrame:
    """(instrument, year, month) expected but without any row."""
    names = spark.createDataFrame([(i,) for i in instruments], "instrument string")
    expected = names.crossJoin(months_covering(spark, start_ns, end_ns))  # instruments times months
    return expected.join(rows.select("instrument", "year", "month").distinct(), ["instrument", "year", "month"], "left_anti")


def require_complete(missing: DataFrame, allow_incomplete: bool = False, shown: int = 5) -> list[tuple]:
    """The holes; with any, and unless allowed, an IntegrityError that names the first of them."""
    holes = [tuple(r) for r in missing.orderBy("instrument", "year", "month").collect()]
    if holes and not allow_incomplete:
        more = f" and {len(holes) - shown} more" if len(holes) > shown else ""
        raise IntegrityError("no data for " + ", ".join(f"{i} {y}-{m:02d}" for i, y, m in holes[:shown]) + more)
    return holes


def latest(rows: DataFrame, keys: list[str], *newest_first) -> DataFrame:
    """One row for each key: the first in the given order. Unlike dropDuplicates it says which."""
    w = W.partitionBy(*keys).orderBy(*newest_first)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def month_gaps(bars: DataFrame) -> DataFrame:
    """prev_gap_ns as it is stored: from the previous bar of the same month, null on the month's first."""
    w = W.partitionBy("instrument", "year", "month").orderBy("ts_utc_ns")
    return bars.withColumn("prev_gap_ns", F.col("first_tick_ns") - F.lag("last_tick_ns").over(w))


def merge_bars(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The new run's bars win; gaps are taken again over each whole month."""
    both = existing.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return month_gaps(latest(both, ["instrument", "ts_utc_ns"], F.desc("_gen")).drop("_gen"))


def merge_ticks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Full duplicates (time, bid, ask) keep the highest row_sequence; then of rows of one time and row_sequence the new run's wins."""
    for side in (existing, new):
        if "row_sequence" not in side.columns:
            raise IntegrityError("ticks without row_sequence are of an older form: import them again")
    both = existing.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    once = latest(both, ["instrument", "ts_utc_ns", "bid", "ask"], F.desc("row_sequence"), F.desc("_gen"))
    return latest(once, ["instrument", "ts_utc_ns", "row_sequence"], F.desc("_gen"), F.desc("bid"), F.desc("ask")).drop("_gen")


def first_rows(rows: DataFrame, keys: list[str], order: list[str], few: int, out: str) -> DataFrame:
    """The first few rows of each key, numbered from 1."""
    return rows.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= few)


def rows_of(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are wanted, each once however often its keys are."""
    return rows.join(wanted.select(*keys), keys, "left_semi")


def merge_features(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("instrument", "ts_utc_ns")) -> DataFrame:
    """The new run's rows win. keys tell rows apart: features of bars have one row for each instant, those of ticks need row_sequence too."""
    both = existing.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return latest(both, [*keys], F.desc("_gen")).drop("_gen")


def upsert(new: DataFrame, root: str, schema: str, merge) -> None:
    """Merges new rows into the table, rewriting only the months that they touch. Those are written aside first, since a
    table can't be overwritten while it is read."""
    spark = new.sparkSession
    new = with_month(new).select(*[f.split()[0] for f in schema.split(", ")], "instrument", "year", "month")
    touched = new.select("instrument", "year", "month").distinct()
    old = scan(spark, root, schema).join(touched, ["instrument", "year", "month"], "left_semi")
    aside = f"{root.rstrip('/')}.staging-{uuid.uuid4().hex}"
    ordered = merge(old, new).repartition("instrument", "year", "month").sortWithinPartitions("instrument", "year", "month", "ts_utc_ns")
    ordered.write.mode("overwrite").options(**ZSTD).partitionBy("instrument", "year", "month").parquet(aside)
    staged = spark.read.schema(f"{schema}, {PARTITIONS}").parquet(aside).repartition("instrument", "year", "month").sortWithinPartitions("instrument", "year", "month", "ts_utc_ns")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**ZSTD).partitionBy("instrument", "year", "month").parquet(root)
    at = spark._jvm.org.apache.hadoop.fs.Path(aside)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_bars(bars: DataFrame, root: str) -> None:
    upsert(bars, root, BARS, merge_bars)


def write_ticks(ticks: DataFrame, root: str) -> None:
    upsert(ticks, root, TICKS, merge_ticks)

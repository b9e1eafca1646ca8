"""Times the reports at the size of the published figures: 2,802,563 one-minute bars of one instrument, made here. Prints one JSON line.

BENCH_BARS: how many bars; BENCH_CPUS: cores; BENCH_PLACE: a folder for the bars (made if it has none).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators import describe as D
from tidemark.operators.resampling import split_bootstrap
from tidemark.sources import ticks as S

PUBLISHED = {"read bars": 2.9, "R1": 31.0, "R2": 5.0, "R5": 274.1}
START = 1_167_609_600_000_000_000  # 2007-01-01, UTC


def make(spark: SparkSession, n: int, root: str) -> None:
    """A walk of n present minutes outside weekends, from 2007 on, by month."""
    minutes = spark.range(int(n * 1.5)).select((F.lit(START) + F.col("id") * T.MINUTE).alias("ts_utc_ns"), "id").where(f"not {T.weekend_gap('ts_utc_ns')} and id % 100 <> 7")
    mid = F.round(1.5 + 0.2 * F.sin(F.col("id") / 90_000) + 0.01 * F.sin(F.col("id") / 700) + F.rand(7) * 0.002, 6)
    b = minutes.orderBy("id").limit(n).withColumn("m", mid).withColumn("s", F.round(0.0001 + F.rand(9) * 0.0002, 6)).withColumn("j", F.rand(11) * 0.0005)
    sides = [F.round(F.col("m") + d * F.col("j") + h * F.col("s"), 6).alias(f"{c}_{x}") for c, h in (("bid", 0), ("ask", 1)) for x, d in (("o", 0.3), ("h", 1), ("l", -1), ("c", -0.2))]
    b = b.select(F.lit("GBPUSD").alias("instrument"), "ts_utc_ns", *sides, F.lit(60).alias("tick_count"), (F.col("ts_utc_ns") + 10**9).alias("first_tick_ns"), (F.col("ts_utc_ns") + 59 * 10**9).alias("last_tick_ns"), F.col("s").alias("spread_open"), (F.col("s") * 2).alias("spread_max"), F.col("s").alias("spread_twa"), F.lit(2 * 10**9).cast("long").alias("prev_gap_ns"))
    S.write_bars(b, root)


def main() -> None:
    n, cpus = int(os.environ.get("BENCH_BARS", "2802563")), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    spark = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory(prefix="bars-") as own:
        root = f"{os.environ.get('BENCH_PLACE') or own}/bars-{n}"
        if not os.path.exists(root):
            make(spark, n, root)
        bars = lambda: S.scan(spark, root, S.BARS)

        def run(df) -> None:
            df.write.format("noop").mode("overwrite").save()

        ratios = lambda: D.session_ratios(bars())
        years = lambda: bars().select("instrument", F.col("year").cast("long").alias("year"), "spread_twa")
        jobs = {
            "read bars": lambda: run(S.read_bars(spark, root)), "R1": lambda: run(D.r1_marginals(ratios())), "R1 with intervals": lambda: run(D.r1_intervals(ratios())),
            "R2": lambda: run(D.r2_buckets(D.r2_days(bars()))), "R2 with intervals": lambda: run(D.r2_intervals(D.r2_days(bars()))), "R5's years, split": lambda: run(split_bootstrap(years(), ["instrument", "year"], "spread_twa", F.col("year") + 1, 500)), "R5": lambda: run(D.r5_by_hour(bars())), "R5 with intervals": lambda: run(D.r5_intervals(bars()).unionByName(D.r5_year_intervals(bars()), allowMissingColumns=True)),
        }
        seconds: dict[str, float] = {}
        run(bars())
        for name, job in jobs.items():
            times = []
            for _ in range(3):
                start = time.perf_counter()
                job()
                times.append(time.perf_counter() - start)
                if sum(times) > 40:
                    break
            seconds[name] = round(sorted(times)[len(times) // 2], 2)
            print(name, [round(t, 2) for t in times], file=sys.stderr)
        print(json.dumps({"metric": "published reports", "bars": n, "unit": "sec", "seconds": seconds, "published": PUBLISHED}))
    spark.stop()


if __name__ == "__main__":
    main()

"""What several operators of this subpackage share: scratch tables, scaling of partition counts, gapless ranks."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of packed fingerprints (or text) that one task takes at a time.
TARGET_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own where that is unset, in local runs only: on a cluster
    each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext.getCheckpointDir()
        if own is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            place = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, place, True)
            spark.sparkContext.setCheckpointDir(place)
            own = spark.sparkContext.getCheckpointDir()
        named = own
    return named.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(drop_scratch)
    _written.append((spark, path))
    return path


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) by Hadoop's API, which reaches whatever store the folder is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop_scratch() -> None:
    """Deletes the tables that this process has written; results that still read them can't be read again."""
    while _written:
        spark, path = _written.pop()
        try:
            fs, at = hadoop_path(spark, path)
            fs.delete(at, True)
        except Exception:  # the session has ended: the cluster's own clean-up of the folder takes over
            continue


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later step reads."""
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)
    if (spark, path) in _written:
        _written.remove((spark, path))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like this one that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, counted over every row."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0)).alias("n")).first()["n"]


def parts_for(spark: SparkSession, n_bytes: float, target: int = TARGET_BYTES) -> int:
    """Partitions so that each holds about target bytes; no fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / target))


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], spread: str, n_rows: int, out: str = "rank", per_task: int = 100_000) -> DataFrame:
    """Numbers rows from 0 within keys, without gaps, though one key may hold most rows.

    Each key is cut by a hash of the column spread into pieces of about per_task rows; rows are numbered within a
    piece and moved up by the counts of the pieces before it. df is read twice and should be a written table.
    """
    pieces = max(8, math.ceil(n_rows / per_task))
    cut = df.withColumn("_cut", F.pmod(F.xxhash64(spread), F.lit(pieces)))
    before = W.partitionBy(*keys).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy(*keys, "_cut").orderBy(*order)) - 1
    return cut.withColumn("_within", within).join(starts, [*keys, "_cut"]).withColumn(out, F.col("_before") + F.col("_within")).drop("_cut", "_before", "_within")

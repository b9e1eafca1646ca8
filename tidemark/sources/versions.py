"""Tables of ticks and bars whose upserts are there whole or not at all.

Data lie in folders that are written once. A manifest, one small file with a number, says which folder each instrument's month is read from; readers take the highest number. An upsert
merges the months that it touches into a folder of its own and then publishes the next manifest in one step that fails if that number is taken: then another writer was first, and the
upsert is made anew on what that one left, or, where the two touched different months, only its manifest is. A writer that dies leaves a folder that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.ticks import BARS, PARTITIONS, TICKS, ZSTD, IntegrityError, merge_bars, merge_ticks, with_month

MONTH = ["instrument", "year", "month"]


class VersionedTable:
    """schema: columns without instrument, year and month. merge(existing, new): the rows of the months that new touches."""

    def __init__(self, spark: SparkSession, root: str, schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame]):
        self.spark, self.root, self.schema, self.merge = spark, root.rstrip("/"), schema, merge
        self._data, self._manifests = f"{self.root}/data", f"{self.root}/manifests"

    @classmethod
    def of_bars(cls, spark: SparkSession, root: str) -> VersionedTable:
        return cls(spark, root, BARS, merge_bars)

    @classmethod
    def of_ticks(cls, spark: SparkSession, root: str) -> VersionedTable:
        return cls(spark, root, TICKS, merge_ticks)

    def _path(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._path(self._manifests)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def months(self, version: int | None = None) -> dict[tuple[str, int, int], str]:
        """The folder of each instrument's month, as of a version: the last one, if none is named."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {}
        if version not in known:
            raise IntegrityError(f"there is no version {version} of {self.root}")
        text = "\n".join(r["value"] for r in self.spark.read.text(f"{self._manifests}/{version:012d}.json").collect())  # a line for each month
        return {(i, y, m): folder for i, y, m, folder in map(json.loads, text.splitlines())}

    def _rows(self, months: dict[tuple[str, int, int], str]) -> DataFrame:
        schema = f"{self.schema}, {PARTITIONS}"
        if not months:
            return self.spark.createDataFrame([], schema)
        folders = sorted({f"{self._data}/version={v}" for v in months.values()})
        named = self.spark.createDataFrame([(v, *k) for k, v in months.items()], "version string, instrument string, year int, month int")
        rows = self.spark.read.option("basePath", self._data).schema(f"{schema}, version string").parquet(*folders)
        # a month that a later version has is in an earlier folder still; the names are partition columns, so such folders are pruned
        return rows.join(F.broadcast(named), ["version", *MONTH], "left_semi").select(*(c.split()[0] for c in schema.split(", ")))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as one manifest has it, whatever is written meanwhile."""
        return self._rows(self.months(version))

    def upsert(self, new: DataFrame, attempts: int = 20) -> int:
        """Merges rows in; the version that has them."""
        new = with_month(new).select(*[f.split()[0] for f in self.schema.split(", ")], *MONTH)
        touched = [tuple(r) for r in new.select(*MONTH).distinct().collect()]  # months of instruments
        if not touched:
            return (self.versions() or [0])[-1]
        base, folder = None, ""
        for _ in range(attempts):
            last = (self.versions() or [0])[-1]
            months = self.months(last)
            before = {k: months.get(k) for k in touched}
            if before != base:  # the first time, or another writer has touched the same months
                base, folder = before, self._merged(new, {k: v for k, v in before.items() if v})
            if self._publish(last + 1, months | dict.fromkeys(touched, folder)):
                return last + 1
        raise IntegrityError(f"{attempts} other writers of {self.root} were first")

    def _merged(self, new: DataFrame, months: dict[tuple[str, int, int], str]) -> str:
        folder = uuid.uuid4().hex
        ordered = self.merge(self._rows(months), new).repartition(*MONTH).sortWithinPartitions(*MONTH, "ts_utc_ns")
        ordered.write.options(**ZSTD).partitionBy(*MONTH).parquet(f"{self._data}/version={folder}")
        return folder

    def _publish(self, version: int, months: dict[tuple[str, int, int], str]) -> bool:
        """Whether this manifest is now the one of that number; False if there was one."""
        jvm = self.spark._jvm
        fs, aside = self._path(f"{self._manifests}/.{uuid.uuid4().hex}")
        final = self._path(f"{self._manifests}/{version:012d}.json")[1]
        out = fs.create(aside, False)
        out.write("\n".join(json.dumps([*k, v]) for k, v in sorted(months.items())).encode())
        out.close()
        try:
            if fs.getScheme() == "file":  # a local rename replaces what is there; a link doesn't
                name = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(name(final), name(aside))
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, options)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        finally:
            fs.delete(aside, False)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes folders that none of the last manifests names, and older manifests; not while others write, as their folders have no manifest yet. What was deleted."""
        known = self.versions()
        named = {f for v in known[-keep:] for f in self.months(v).values()}
        fs, at = self._path(self._data)
        gone = [s.getPath() for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName().removeprefix("version=") not in named]
        old = [self._path(f"{self._manifests}/{v:012d}.json")[1] for v in known[:-keep]]
        for path in [*old, *gone]:
            fs.delete(path, True)
        return [p.getName() for p in gone]

"""Token counts as rollups that signed deltas maintain.

Totals by source, language and tokenizer version are sums of committed batches, each of which is stored as its own small rollup. A batch of inserts,
deletes and revised counts is summed first and written aside; it is committed by publishing a small manifest under its id that names the folder with the data. Readers know only
what manifests name, so a batch is there whole or not at all. A manifest comes into being in one step that fails where there is one already (a hard link on a local file
system, a rename without overwriting on any other; the store must offer that, as HDFS does): a repeated commit of an id changes nothing, and of several commits of one id at a
time exactly one wins. compact() folds all batches so far into a snapshot, published the same way, with a table of the ids that it holds.

Defined results: a null source, language or version is a group of its own; a null count is 0; an unknown operation fails the
batch before anything is committed; repeated rows of a batch count each; an empty batch is committed and changes nothing; groups without documents and tokens are left out of totals;
texts of any length are counted whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.packing import byte_bpe
from tidemark.llm.shared import hadoop_path, scratch_path, written

GROUP = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Columns of a batch: operation (insert, delete or revise), the group, the count, and for revise the count before.
DELTA = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, kind: str) -> list[str]:
        fs, at = hadoop_path(self.spark, f"{self.path}/{kind}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _data(self, kind: str) -> dict[str, str]:
        """The published names, each with its data folder: one short line for each batch or snapshot."""
        if not self._names(kind):
            return {}
        rows = self.spark.read.text(f"{self.path}/{kind}", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
        return {r["name"]: f"{self.path}/data/{r['value']}" for r in rows}

    def _publish(self, kind: str, name: str, data: str) -> bool:
        """Makes the manifest, which holds the name of the data folder; False, and the data deleted, if there is one of that name."""
        fs, final = hadoop_path(self.spark, f"{self.path}/{kind}/{name}")
        fs.mkdirs(final.getParent())
        aside = hadoop_path(self.spark, f"{self.path}/aside/{data}.manifest")[1]
        fs.mkdirs(aside.getParent())
        out = fs.create(aside, True)
        out.write(bytearray(data.encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if fs.getScheme() == "file":
                local = [jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath() for p in (final, aside)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, options)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            fs.delete(hadoop_path(self.spark, f"{self.path}/data/{data}")[1], True)
            return False
        finally:
            fs.delete(aside, False)
        return True

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch; False, without reading it, if its id has been committed."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch):
            raise ValueError(f"batch id {batch!r}: letters, digits, _ and - only")
        if batch in self._names("batches"):
            return False
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
        sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null")))).cast("int"))
        new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        tokens = F.when(F.col("op") == "revise", new - old).otherwise(sign * new)
        data = uuid.uuid4().hex
        deltas.groupBy(*GROUP).agg(F.sum(sign).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens")).write.parquet(f"{self.path}/data/{data}")
        return self._publish("batches", batch, data)

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The last snapshot's data folder and the ids that it holds."""
        if not (found := self._data("snapshots")):
            return None, set()
        data = found[max(found)]
        return f"{data}/totals", {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{data}/batches").collect()}

    def _summed(self) -> tuple[DataFrame, set[str]]:
        """Totals, and the ids of the batches in them."""
        (totals, folded), batches = self._snapshot(), self._data("batches")
        paths = [data for name, data in batches.items() if name not in folded] + ([totals] if totals else [])
        parts = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        summed = parts.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
        return summed, folded | set(batches)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        return self._summed()[0]

    def compact(self) -> bool:
        """Folds all batches into a new snapshot; False if another one has been published meanwhile. The folded batches' data can go once no reader uses
        it; their manifests stay, so that an id is never committed again."""
        data, number = uuid.uuid4().hex, len(self._names("snapshots"))
        summed, batches = self._summed()
        summed.write.parquet(f"{self.path}/data/{data}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(batches)], "batch string").write.parquet(f"{self.path}/data/{data}/batches")
        return self._publish("snapshots", f"{number:08d}", data)


def count_tokens(docs: DataFrame, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, text_md5, n_bytes, n_words, n_bpe): counts of whole texts; null text: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(json_path, rank_path)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            counts = [(len(t.encode().split()), len(bpe.ids(t))) for t in texts]
            at = batch.schema.get_field_index("text")
            rest = batch.remove_column(at)
            yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1))], [*rest.schema.names, "n_words", "n_bpe"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.md5(text.cast("binary")).alias("text_md5"), F.octet_length(text).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, text_md5 string, n_bytes long, n_words long, n_bpe long")


def corpus_totals(docs: DataFrame, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """Token totals of a whole corpus as its history makes them: every document is inserted with its words and with an estimate of its
    ids (a fourth of its bytes), then the estimates are revised to real counts, then all copies but the one with the smallest id are deleted, and
    then they are inserted again, so that the totals are those of every row. The batch that deletes is committed twice, as after a lost answer, and counts once."""
    spark = docs.sparkSession
    counted = written(count_tokens(docs, json_path, rank_path), "counts")
    estimate, none = F.ceil(F.col("n_bytes") / 4).cast("long"), F.lit(0).cast("long")

    def deltas(rows: DataFrame, op: str, version: str, tokens, old=none) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer"), tokens.alias("tokens"), old.alias("old_tokens"))

    first = counted.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    copies = written(counted.where("doc_id is not null").join(first, "doc_id", "left_anti"), "copies")
    words, bpe = "words-1", "byte_bpe_50k"
    state = Rollup(spark, scratch_path(spark, "rollup"))
    state.commit("load", deltas(counted, "insert", words, F.col("n_words")).union(deltas(counted, "insert", bpe, estimate)))
    state.commit("count", deltas(counted, "revise", bpe, F.col("n_bpe"), estimate))
    both = {op: deltas(copies, op, words, F.col("n_words")).union(deltas(copies, op, bpe, F.col("n_bpe"))) for op in ("delete", "insert")}
    for _ in range(2):
        state.commit("copies", both["delete"])
    state.compact()
    state.commit("copies-again", both["insert"])
    return state.totals()

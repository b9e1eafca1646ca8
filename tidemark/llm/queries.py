"""One query for each operator, over the whole of its table, with the parameters used in production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.alignment import align_tokenizers
from tidemark.llm.chroma import align, render_turn
from tidemark.llm.decontamination import find_contamination
from tidemark.llm.exact import exact_groups
from tidemark.llm.html import extract_pages
from tidemark.llm.packing import pack_documents
from tidemark.llm.repair import SUMMARY, damaged, repair_conversations
from tidemark.llm.repair_sql import REPAIR
from tidemark.llm.rollups import corpus_totals
from tidemark.llm.secrets import scan_secrets
from tidemark.llm.sharding import shard_documents
from tidemark.llm.similarity import near_components
from tidemark.llm.substrings import remove_repeats
from tidemark.llm.toxicity import fit_on, score_documents


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_read(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    as_text = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", as_text).cast("binary"), 256).alias("items_sha256"), "contaminated")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_totals(_read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return score_documents(docs, fit_on(docs, _read(spark, sf_dir, "labels")))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_read(spark, sf_dir, "pages"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds audio, so every turn of every conversation is rendered as a melody first (one of few words is repeated); the turns of
    conversations whose id is divisible by 100 are looked for among all turns. A row for each turn, with its class, and one for each two classes that align."""
    recordings, matches = align(_read(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", F.col("conv_id") % 100 == 0, render_turn)
    return recordings.withColumn("kind", F.lit("recording")).unionByName(matches.withColumn("kind", F.lit("match")), allowMissingColumns=True)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_read(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_read(spark, sf_dir, "documents"), with_groups=False)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations of the table, also those that damage leaves without rows."""
    conversations = _read(spark, sf_dir, "conversations")
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    found = ids.join(repair_conversations(damaged(conversations)).summary.withColumn("_found", F.lit(True)), F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    names = [c.split() for c in SUMMARY.split(", ")][1:]
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return found.select(F.col("_id").alias("conv_id"), *(F.coalesce(c, nothing.get(c, F.lit(0).cast("long"))).alias(c) for c, _ in names))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_sharding": op3_sharding,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scans": op8_secret_scans,
    "op9_html_extraction": op9_html_extraction,
    "op10_media_columns": op10_media_columns,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL: dict[str, str] = {
    "op11_exact_dedup": r"""
        WITH normalised AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\x0C\r]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
        FROM normalised WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)""",
    "op13_conversation_repair": REPAIR,
}

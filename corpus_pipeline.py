"""From raw documents to packed training sequences: five stages, each on all that the one before has kept.

Every stage but the last returns the columns of documents. Toxic documents go, one document of each group of near duplicates stays (five-word
shingles, similarity 0.8 or more), documents contaminated by benchmark items go, secrets are replaced in the text (n_chars follows), and what is left is packed.

Defined results, of every stage: rows without an id are no duplicates of anything and stay; a null text is empty and stays (packed as its end mark alone); of repeated rows one
stays; texts of any length are judged and kept whole; an empty table gives an empty one, with all columns; further columns of documents, whatever their names, are kept
up to packing, which returns its own. Missing labels leave all documents, an empty benchmark too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontamination import keep_uncontaminated
from tidemark.llm.packing import pack_documents
from tidemark.llm.secrets import redact_secrets
from tidemark.llm.shared import written
from tidemark.llm.similarity import keep_representatives
from tidemark.llm.toxicity import fit_on, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Scoring by a trained model, connected components and tokenizing have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on sf_dir's documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

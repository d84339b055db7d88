"""The corpus pipeline: five stages, each on what the stage before kept, each written to Parquet before the next reads it.

Defined results, for every stage: an empty table gives an empty one; other columns are carried along, whatever their names; rows are told
apart by their place, so rows with null or equal ids are rows of their own; texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.contamination import decontaminate
from tidemark.llm.encoder import vocabulary_path
from tidemark.llm.jaccard import keep_one
from tidemark.llm.packing import pack
from tidemark.llm.pii import redact_documents
from tidemark.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, those with a null or an empty text among them. Repeated rows share their verdict."""
    common.prepare(spark)
    return keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones stays, the one with the least id; a null id comes last, and of equal ones the first row stays. Texts without words all stay."""
    common.prepare(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. A null text holds none; without items nothing goes."""
    return decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` is counted anew. A null text stays null."""
    common.prepare(spark)
    return redact_documents(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequences; a null text is an empty one, of the end id alone."""
    common.prepare(spark)
    return pack(docs, vocabulary=vocabulary_path("byte_bpe_50k.json"), lean=True)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontamination), ("PII", pii), ("best-fit packing", packing)]

#: Encoding and language-model scoring have no SQL form; the stages are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialize(docs, f"stage{i}")
    return docs

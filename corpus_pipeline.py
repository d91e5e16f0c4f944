"""From raw documents to packed token sequences: five stages, each a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glycospark.llm.common import settle, table
from glycospark.llm.decontaminate import drop_contaminated
from glycospark.llm.minhash import drop_near_duplicates
from glycospark.llm.packing import pack_texts
from glycospark.llm.q_packing import tokenizer_files
from glycospark.llm.quality import keep_good
from glycospark.llm.secrets import redact


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate class."""
    return drop_near_duplicates(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that quote the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; no document goes."""
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document."""
    return pack_texts(docs, tokenizer_files())


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("secret scan", without_secrets),
    ("packing", packed),
]

# the classifier is trained, which SQL does not express; tests/llm compare each stage with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

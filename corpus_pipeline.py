"""The corpus pipeline: language, near copies, benchmark leaks, private data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import keep
from sluice.llm.decontaminate import clean
from sluice.llm.lang_gru import identified, remainder
from sluice.llm.packing import pack_documents
from sluice.llm.pii_crf import redact
from sluice.llm.queries import vocabulary
from sluice.llm.simhash import deduplicate


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network knows; others go."""
    return identified(docs, remainder(docs["doc_id"]) != 2)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document of the smallest doc_id stays."""
    return deduplicate(docs, shingle=5, least="0.8")


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids."""
    return pack_documents(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", in_a_language),
    ("near_copies", one_of_each),
    ("leaks", without_leaks),
    ("private_data", without_private_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs


#: The network, the field and the packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL: str | None = None

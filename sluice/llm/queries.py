"""The queries of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.byte_shards import byte_shards
from sluice.llm.cover_tree import top_k
from sluice.llm.decontaminate import leaks
from sluice.llm.html_text import extract
from sluice.llm.lang_gru import identify, remainder
from sluice.llm.masked_lm import score
from sluice.llm.packing import pack_documents
from sluice.llm.pii_crf import find
from sluice.llm.simhash import near_duplicates
from sluice.llm.sql import ORACLE_SQL
from sluice.llm.suffix_dedup import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by inner product of every hundredth vector, over all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op2_tag_ratio_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def vocabulary() -> str:
    """The public vocabulary file that packing counts with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 4096 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op4_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the pattern spans, and all spans."""
    return find(table(spark, sf_dir, "documents"))


def op5_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's summed conditional log-probability under a model of all documents."""
    return score(table(spark, sf_dir, "documents"))


def op6_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words without passages of 20 words that occur earlier."""
    kept = remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-copy component."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("sig")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op8_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; rows of remainder 2 are held out from training."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, remainder(docs["doc_id"]) != 2).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight contiguous shards of nearly equal bytes."""
    placed = byte_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_edit_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds within the item's edit budget."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cover_tree_topk": op1_cover_tree_topk,
    "op2_tag_ratio_text": op2_tag_ratio_text,
    "op3_nnls_packing": op3_nnls_packing,
    "op4_pii_field": op4_pii_field,
    "op5_masked_likelihood": op5_masked_likelihood,
    "op6_prefix_suffix_trees": op6_prefix_suffix_trees,
    "op7_simhash_pigeonring": op7_simhash_pigeonring,
    "op8_language_gru": op8_language_gru,
    "op9_byte_shards": op9_byte_shards,
    "op10_edit_leaks": op10_edit_leaks,
}

__all__ = ["ORACLE_SQL", "QUERIES"]

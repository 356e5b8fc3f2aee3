"""The registered queries of this package and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import sql
from pulseframe.llm.block_ann import nearest
from pulseframe.llm.brown_lm import brown_scores
from pulseframe.llm.fill_in_middle import fill_in_middle, middle_digests
from pulseframe.llm.html_extract import extract_pages
from pulseframe.llm.language_id import fit_language_model, predict_languages
from pulseframe.llm.minhash_dedup import near_duplicate_components
from pulseframe.llm.negative_mining import hard_negatives
from pulseframe.llm.piece_codec import read_model, tokenized
from pulseframe.llm.pivot_search import top_products
from pulseframe.llm.secret_scan import secret_report
from pulseframe.llm.sequence_packing import packed, piece_checksums
from pulseframe.llm.source_mix import mix_positions
from pulseframe.llm.substring_dedup import kept_digest, remove_duplicate_passages


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of each page."""
    return extract_pages(_table(spark, folder, "pages"))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of each document, decoded again for comparison."""
    return tokenized(_table(spark, folder, "documents"), read_model())


def op3_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The component of near duplicates of each document."""
    return near_duplicate_components(_table(spark, folder, "documents"))


def op4_brown_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of each document under word frequencies and under Brown classes."""
    return brown_scores(_table(spark, folder, "documents"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each document, learned from the labels of two folds of three."""
    docs = _table(spark, folder, "documents")
    return predict_languages(docs, fit_language_model(docs))


def op6_block_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 vectors of largest inner product for each vector whose id is divisible by 20."""
    return nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_pivot_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 largest integer inner products for each vector whose id is divisible by 100."""
    return top_products(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each document in a mix of sources by the square root of their sizes."""
    return mix_positions(_table(spark, folder, "documents"))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words left of each document once passages of earlier documents are gone."""
    return kept_digest(remove_duplicate_passages(_table(spark, folder, "documents")))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in each document."""
    return secret_report(_table(spark, folder, "documents"))


def op11_negative_mining(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives for each vector whose id is divisible by 100; labels of ids divisible by 7 are moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_sequence_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of each document in sequences of 4,096 tokens."""
    return piece_checksums(packed(_table(spark, folder, "documents"), as_bytes=True))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Each document in fill-in-middle order, and restored from it."""
    return middle_digests(fill_in_middle(_table(spark, folder, "documents")))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_minhash_dedup": op3_minhash_dedup,
        "op4_brown_lm": op4_brown_lm,
        "op5_language_id": op5_language_id,
        "op6_block_ann": op6_block_ann,
        "op7_pivot_search": op7_pivot_search,
        "op8_source_mix": op8_source_mix,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_secret_scan": op10_secret_scan,
        "op11_negative_mining": op11_negative_mining,
        "op12_sequence_packing": op12_sequence_packing,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def llm_oracles() -> dict[str, str]:
    return {
        "op3_minhash_dedup": sql.MINHASH_DEDUP,
        "op6_block_ann": sql.BLOCK_ANN,
        "op7_pivot_search": sql.PIVOT_SEARCH,
        "op9_substring_dedup": sql.SUBSTRING_DEDUP,
        "op11_negative_mining": sql.NEGATIVE_MINING,
        "op13_fill_in_middle": sql.FILL_IN_MIDDLE,
    }

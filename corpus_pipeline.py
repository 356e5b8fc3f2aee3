"""A cleaning pipeline over the documents table: language, near duplicates, secrets, source mix, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.frames import checkpointed
from pulseframe.llm.language_id import fit_language_model
from pulseframe.llm.minhash_dedup import JoinSettings, without_near_duplicates
from pulseframe.llm.piece_codec import encoded, read_model
from pulseframe.llm.secret_scan import without_secrets
from pulseframe.llm.source_mix import mixed, numbered


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters and those below the calibrated score go."""
    accepted = fit_language_model(docs).predict(F.col("row.text")).getField("accepted")
    return docs.select(F.struct("*").alias("row")).where(accepted).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (runs of five words, similarity 0.8), the one of the smallest id."""
    return without_near_duplicates(docs, settings=JoinSettings(shingle=5))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by [secret] and n_chars counted anew where the text has changed."""
    rows = docs.select(F.struct("*").alias("row"), without_secrets(F.col("text")).alias("clean"))
    changed = {"text": F.col("clean.text"), "n_chars": F.when(F.col("clean.found"), F.length("clean.text").cast("long")).otherwise(F.col("row.n_chars"))}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in an order that interleaves the sources by the square root of their sizes."""
    return mixed(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document; round_trip tells whether decoding gives the text back. Files are read in any order, so mix_position, by
    which the rows are in mixed order, is found anew: it depends on the rows only."""
    rows = numbered(docs).select("mix_position", "row.doc_id", "row.source", "row.lang", encoded(F.col("row.text"), read_model()).alias("found"))
    return rows.select("mix_position", "doc_id", "source", "lang", "found.pieces", F.size("found.pieces").cast("long").alias("n_pieces"), "found.round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("minhash_dedup", one_of_each_group),
    ("secret_scan", no_secrets),
    ("source_mix", in_mixed_order),
    ("sentencepiece", as_pieces),
]

#: No stage but the order of rows can be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

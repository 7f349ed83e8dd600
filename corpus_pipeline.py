"""A training corpus in five stages, each one operator of kmerlake.llm over all that the stage before it kept.

Every stage but the last returns the columns of documents. SQL can express none of the stages but exact dedup, so
ORACLE_SQL is None; tests/llm holds the dedup stages against a brute-force version, language_id's rows against profiles made
without the operator, and mix_sources against the operator itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.llm import lang_id, near_dedup, pieces
from kmerlake.llm.common import staged, table
from kmerlake.llm.exact_dedup import DigestIndex, drop_copies
from kmerlake.llm.mixing import Mix


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that resemble a language: rejected are texts without a letter, and those whose best cosine is one that an unrelated
    text reaches with a chance of 1 % or more (lang_id.noise_bound). Profiles come from the documents outside the held-out fifth."""
    return lang_id.accept(docs, lang_id.fit(docs.filter(lang_id.in_training(F.col("doc_id")))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the largest doc_id."""
    index = DigestIndex.at(spark)
    kept = drop_copies(docs, index)
    index.drop()  # the labels are a table of their own
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return Mix(docs).apply(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that the mix took, with their digest and whether they decode to its text."""
    return pieces.encode(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("encode_pieces", encode_pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

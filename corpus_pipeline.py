"""Corpus pipeline: language ID, quality rules, near duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor
kept. Stages but the last return the columns of ``documents``; ``run`` writes every stage's
result as Parquet to the shared folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.hilbert_packing import pack_documents
from seqloom.llm.language_id import UNDETERMINED, identify_languages, learn_profiles
from seqloom.llm.ngram_jaccard import one_per_component
from seqloom.llm.queries import tokenizer_path
from seqloom.llm.repetition_rules import keep_documents
from seqloom.session import scratch_path

#: Smallest language score of a text that stays; texts in a learned language score 0.4 and more.
MIN_LANGUAGE_SCORE = 0.2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in one of the languages learned from the rows themselves; texts without letters or unlike all go."""
    names = ("__lang_pred", "__lang_score")
    named = identify_languages(docs, learn_profiles(docs), out=names)
    return named.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= MIN_LANGUAGE_SCORE)).drop(*names)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that pass the repetition rules."""
    return keep_documents(docs)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one text of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return one_per_component(docs, percent=80, width=5)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens: one row per piece."""
    pieces = pack_documents(docs, tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_duplicates", duplicates_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the language profiles and the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

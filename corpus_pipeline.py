"""A corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

Documents whose language is not recognised go, then all but one of each group
of near copies, then those that hold benchmark passages; personal data is
replaced by pseudonyms; at last sources are mixed to their target weights. All
stages but the last return the columns of documents, the last adds `copy`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.llm.common import cut, held_out, table, word_count
from wickwork.llm.decontamination import decontaminate
from wickwork.llm.language_id import FOLDS, HELD, keep_identified, learn
from wickwork.llm.mixing import mixed_texts
from wickwork.llm.pii import pseudonymise, session_key
from wickwork.llm.shingle_dedup import shingle_groups
from wickwork.llm.simhash_dedup import keep_one


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language, learned from those that name theirs."""
    return keep_identified(docs, learn(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", FOLDS, HELD))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 or more of their five-word shingles in common."""
    return keep_one(docs, shingle_groups)


#: Words of the shortest benchmark item that decides over a document: any clean text may hold a shorter one, such as "Yes".
LEAST_ITEM = 5


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str, least: int = LEAST_ITEM) -> DataFrame:
    """Documents without benchmark passages of `least` words or more."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark").where(word_count("text") >= least))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms under the session's key; n_chars, where there is one, follows the text."""
    counted = max((c for c in docs.columns if c.lower().startswith("n_pii")), key=len, default="n_pii") + "_"
    done = pseudonymise(docs, session_key(docs.sparkSession), counted).drop(counted)
    return done.withColumn("n_chars", F.length("text").cast("bigint")).select(*[f"`{c}`" for c in docs.columns]) if "n_chars" in docs.columns else done


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document that it takes."""
    return mixed_texts(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: The stages learn models, hash and permute; SQL cannot express them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

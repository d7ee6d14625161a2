"""A training-data pipeline over `documents`: five stages, each one operator of rollcall.llm.

Each stage gets all that its predecessor kept, as written and read again; all but the last return the columns of
documents. What a stage decides takes effect: it drops rows (language, near-duplicates, benchmark passages), rewrites
text (personal data) or replaces it by ids (BPE).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import bpe, decontam, langid, order_minhash, pii
from rollcall.llm.common import stash, table
from rollcall.llm.queries import vocabulary

#: A text whose n-grams are further out of place than this in every profile is in no known language.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled ones teach; texts that are null or without letters go."""
    judged = langid.predict(docs, langid.profiles(docs))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the least doc_id, of each class of copies and near-duplicates."""
    return order_minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents into which a passage of the benchmark has leaked."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in texts by the kind in brackets; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the token ids, and the digest of what they decode to."""
    return bpe.digest(docs, vocabulary(), with_ids=True)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe", encoding),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

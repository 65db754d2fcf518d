"""Documents to token ids: language, near-duplicates, benchmark passages, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents. Stages are written as Parquet in the shared folder and read again, so a lost executor costs no
more than a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import bpe, decontaminate, jaccard, language, pii
from lotwise.llm.common import held_out, saved, table

#: SQL cannot express the language model and the token merges
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the model is fitted on the documents of the training folds."""
    return language.keep_identified(docs, language.fit(docs.filter(~held_out(F.col("doc_id")))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of documents that are linked by their word shingles."""
    return jaccard.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by its kind; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids as little-endian unsigned 32-bit integers, decoded again as a check."""
    return bpe.encode(docs, decoded=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("byte_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of five stages, each one of the operators of plumbline.llm.

Each stage gets what the stage before it kept and returns the columns of documents; the last returns token ids.
Rows with nulls, empty texts and extra columns pass as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, mixing, quality, simhash, substr
from plumbline.llm.common import forget, read_table, written
from plumbline.llm.queries import trusted_ids


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.accepted(docs, trusted_ids(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints within 4 of 64 bits, which is wider than the 2 bits of the
    query of the operator, as copies with five-word similarity of 0.8 or more are hardly ever within 2."""
    return simhash.keep_one(docs, bits=4, segments=13)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id has; n_chars follows the text."""
    out = substr.remove_repeats(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixing.mixed_rows(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mix, with digests of the ids and of the decoded text."""
    return bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

#: Hashed n-grams, SimHash and merges cannot be said in DuckDB SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir))
        forget(docs)  # the stage before, if it was one
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

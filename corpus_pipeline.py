"""A corpus pipeline: five stages over `documents`, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.llm import bpe, common, decontaminate, linededup, quality, simhash

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier than not of the highest grade: neither toxic nor poor."""
    model = quality.fit(docs, common.read(spark, sf_dir, "labels"), quality.grade_of_labels())
    return quality.select(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of 20 characters or more that stand earlier, or stand there within one edit; shorter ones repeat in clean prose, too."""
    return linededup.clean(docs, exact_chars=linededup.MIN_CHARS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: at least 0.8 similar in shingles of five words."""
    return simhash.similar_representatives(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are half of it or more go."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the digest of the bytes that the ids decode to."""
    decoded = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

#: Hashing, tokenising and training aren't in SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, common.stash(docs) if i else docs, sf_dir)
    return docs

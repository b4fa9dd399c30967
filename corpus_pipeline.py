"""From raw documents to an encoded training mix, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weblode.llm import bpe, exact_dedup, kn_quality, mixing, ngram_join
from weblode.llm.common import documents, stored, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of trusted text does not find too surprising for their language."""
    return kn_quality.accepted_rows(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier."""
    return exact_dedup.keep_one(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word shingle Jaccard of 0.8 or more, the one with the smallest identifier."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, of every row of the mix."""
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written to the shared folder and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: SQL states neither the fitted classifier nor the fitted mix; tests compare the run with a brute-force version.
ORACLE_SQL = None

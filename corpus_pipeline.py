"""Corpus preparation: the stages that turn raw documents into packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  ``run`` writes
what a stage returns to the shared folder and hands the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landloom.llm import mixing, packing, quality, simhash, toxicity
from landloom.llm.common import read_table, written
from landloom.llm.queries import MIX_WEIGHTS, TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; null texts are judged as empty ones, an empty table gives no row."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source; null and empty texts go."""
    return quality.good_rows(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints; null and empty texts are one group."""
    return simhash.one_of_each(docs, distance=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, repeated rows equally often; what it takes never, null texts too, is left out."""
    return mixing.mixed(docs, MIX_WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens; a null or empty text is its end id."""
    return packing.packed(docs, TOKENIZER, end_id=1, max_len=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A classifier, hashes and a tokenizer are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", "zstd")
    return docs

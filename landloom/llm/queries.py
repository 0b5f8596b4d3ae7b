"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm import bestfit, embeddings, html, idfile, mixing, negatives, packing, quality, simhash, tokens, toxicity, trie, warc
from landloom.llm.common import read_table

#: Tokenizer of the token operators.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Weights that the sources take in turn.
MIX_WEIGHTS = [3, 1, 2]


def op1_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = warc.records(read_table(spark, sf_dir, "pages"))
    return warc.audit(kept, warc.damaged(kept))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"), TOKENIZER, limit=2048)


def op4_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.id_file_digest(read_table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(read_table(spark, sf_dir, "pages"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), distance=2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"), TOKENIZER, end_id=1, max_len=2048)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.best_packed(read_table(spark, sf_dir, "documents"), TOKENIZER, end_id=0, max_len=2048)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_openings(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_audit, op2_quality_rules, op3_token_counts, op4_bit_packed_ids, op5_html_text, op6_simhash_dedup, op7_toxicity, op8_embedding_dedup, op9_mixing, op10_packing, op11_best_fit_packing, op12_hard_negatives, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_audit": warc.AUDIT_SQL, "op8_embedding_dedup": embeddings.near_vectors_sql(0.98), "op9_mixing": mixing.mix_sql(MIX_WEIGHTS), "op12_hard_negatives": negatives.hard_negatives_sql(), "op13_prefix_trie": trie.shared_openings_sql()}

"""Registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import (
    bpe,
    chat_tree,
    hard_negatives,
    int8_tiles,
    lang_crf,
    line_crf,
    packing,
    passages,
    periodic_runs,
    quality_trees,
    secret_scan,
    simhash,
    url_filter,
)
from tallymark.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return int8_tiles.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.train())


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_trees.score(docs, quality_trees.train(docs, table(spark, sf_dir, "labels")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lang_crf.identify(docs, lang_crf.train(docs))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    nodes, members = chat_tree.format_tree(rows.union(own), RANKS, public_tokenizers.PATTERN)
    return chat_tree.read_back(nodes, members, RANKS, public_tokenizers.PATTERN)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.strip(table(spark, sf_dir, "documents")).drop("kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train())


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.detect(table(spark, sf_dir, "documents"), plant=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_quality,
        op2_embedding_dedup,
        op3_url_filter,
        op4_quality_trees,
        op5_byte_bpe,
        op6_language_id,
        op7_simhash,
        op8_chat_tree,
        op9_repeated_passages,
        op10_packing,
        op11_secret_scan,
        op12_hard_negatives,
        op13_periodic_runs,
    )
}


def oracles() -> dict[str, str]:
    """SQL where DuckDB can express a query; the others are tested against brute force and held-out rows."""
    return {
        "op3_url_filter": url_filter.oracle(url_filter.train()),
        "op11_secret_scan": secret_scan.oracle(secret_scan.train()),
        "op12_hard_negatives": hard_negatives.ORACLE,
    }

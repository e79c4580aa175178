"""The queries of the corpus operators, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, language, lm, mixing, oracles, packing, quality, rules, substrings, vectors
from .common import crc_mod

#: Name of the tokenizer's file; its place comes from the installed package.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.weigh(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.95)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), 35)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), path=public_tokenizers.path(TOKENIZER), limit=2048)


def op7_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"), 5, 0.8).select("doc_id", "class_id", "n_links", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_model": op3_language_model,
    "op4_vector_links": op4_vector_links,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quote_links": op7_quote_links,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_language_id": op9_language_id,
    "op10_jaccard_join": op10_jaccard_join,
}
ORACLES: dict[str, str] = {
    "op1_mix_sources": oracles.MIX,
    "op4_vector_links": oracles.VECTORS,
    "op5_substring_dedup": oracles.SUBSTRINGS,
    "op10_jaccard_join": oracles.JACCARD,
}

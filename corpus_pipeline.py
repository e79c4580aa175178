"""A corpus pipeline: language, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents: doc_id, text, lang, source, n_chars.

Null and repeated ids, null or empty texts, nulls in other columns and rows repeated whole have the results that each
stage's operator states; an empty table gives no rows; columns beyond those of documents are left out, whatever their
names. A text that is null or has no letters ends at the language stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import jaccard, language, mixing, packing, substrings
from driftloom.llm.common import delete, settled, shared_dir, sweep
from driftloom.llm.queries import TOKENIZER

#: Columns of documents that the stages hand on.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found stay; the predicted language replaces lang.

    A text without letters, or whose decoded share is under one half, goes.
    """
    return language.tagged(docs, language.learn(language.training(docs))).filter("not ambiguous").select(
        "doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars"
    )


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays, the one with the smallest id; texts without a word all stay."""
    return jaccard.kept_rows(docs, jaccard.join(docs.select("doc_id", "text"), 5, 0.8)).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated 35-word passages go; a text that loses all its words goes; others keep their text as it is."""
    cut = substrings.trimmed(docs, 35).filter("n_removed = 0 or n_words > n_removed")
    return cut.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice."""
    mixed = mixing.mix(docs)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    return mixed.withColumn("_time", F.explode(F.array_repeat(F.lit(1), times))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences."""
    return packing.pack(docs.select("doc_id", "text"), path=public_tokenizers.path(TOKENIZER), limit=2048)


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("mix_sources", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: The stages' hashes and models have no equal in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it.

    Once a stage is written, what it was made from is deleted there: the stage before and its intermediate tables. The
    last stage's folder is the caller's.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES:
        path, before = f"{base}/{name}", settled()
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        sweep(before)
        if done:
            delete(spark, done)
        done = path
    return docs

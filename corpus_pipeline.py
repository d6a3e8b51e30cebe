"""Corpus preparation in five stages: language ID, near-dedup, decontamination, mixing to target weights, token files.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and all but the last return the columns
of ``documents``; ``run`` writes each result as Parquet and reads it for the next. Columns beyond those of ``documents`` pass all
stages but the last, whatever their names; names that begin with two underscores are reserved. Documents with a null doc_id are
documents like any other. An empty table, or one of which nothing is kept, gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastertable.llm import decontaminate, language_id, mixing, simhash_dedup, token_files
from rastertable.llm.shared import spread, written


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: no text, no letter, or far from every language. Without a labelled document all are."""
    model = language_id.fit(docs.where(~language_id.is_held_out()))
    found = language_id.predict(docs, model, names=("__lang", "__score", "__rejected"))
    return found.where(~F.col("__rejected")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each SimHash component (of equal rows, one)."""
    found = simhash_dedup.near_duplicates(docs, simhash_dedup.wide_key())
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("least")).select(F.col("least.row_key").alias("__key"))
    #: One row of each key is taken before the rows are shuffled, so that a row repeated very often never meets in one task.
    first = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    single = docs.withColumn("__key", simhash_dedup.wide_key()).withColumn("__copy", first).where("__copy = 1")
    return single.join(kept, "__key", "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    keyed = docs.withColumn("__key", simhash_dedup.wide_key())
    hits = decontaminate.matches(keyed.select(F.col("__key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "binary")
    found = written(hits.select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    return keyed.join(found, "__key", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each whole document as often as the mix takes it, by rounding."""
    return mixing.mixed(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the mixed documents into token files and returns what they hold of each document."""
    blocks = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(blocks)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_language),
    ("near_dedup", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_files", write_token_files),
]

#: SQL expresses neither the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

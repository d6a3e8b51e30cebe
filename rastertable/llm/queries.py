"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertable.llm import ann, chat, decontaminate, language_id, license_scan, minhash_dedup, mixing, periodic_runs, sharding, simhash_dedup, spelling_variants, token_counts, token_files
from rastertable.llm.oracles import ORACLE_SQL as ORACLE_SQL
from rastertable.llm.shared import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    blocks = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(blocks)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files, _ = sharding.write_shards(docs, 24)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return files.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.is_held_out()))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.is_held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", "fingerprint", "component_id")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.search(table, table.where(F.col("vec_id") % 100 == 0))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(documents(spark, sf_dir), periodic_runs.repeated_tail)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(documents(spark, sf_dir))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_license_scan": op2_license_scan,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_chat": op7_chat,
    "op8_simhash": op8_simhash,
    "op9_ann": op9_ann,
    "op10_decontaminate": op10_decontaminate,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_minhash": op13_minhash,
}

"""Ordering, limits and deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order; give a key last, so that ties do not move between pages."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, last: object, limit: int) -> DataFrame:
    """The page that follows the key ``last`` (None: the first): a comparison that reaches the scan, so deep pages cost no more."""
    rows = df if last is None else df.where(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(limit)


def limit_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """All rows of the first ``n`` groups by key."""
    return df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def arithmetic_hash(c: Column, seed: int = 42) -> Column:
    """A multiplicative hash of a small integer id that any SQL engine can state."""
    return ((c + seed) * F.lit(2654435761)) % F.lit(4294967296)


def random_order(c: Column, seed: int = 42) -> Column:
    return F.xxhash64(c, F.lit(seed))


def random_sample(df: DataFrame, n: int, order: Column, key: str) -> DataFrame:
    """``n`` rows, uniform without replacement, the same on each run: the least hashes. Spark keeps ``n`` rows in each task."""
    return df.orderBy(order, key).limit(n)


def stratified_sample(df: DataFrame, stratum: str, limit: int, order: Column, key: str, mode: str = "prop") -> DataFrame:
    """A sample of about ``limit`` rows by stratum, the same on each run.

    ``prop``: max(1, floor(limit * size / total)) rows of each stratum; ``equal``: max(1, limit // strata). The result is cut to
    ``limit`` in the order of the strata. A null stratum is "Unknown". Each stratum keeps its rows of least hash; Spark limits them
    before the shuffle, so a large stratum is never gathered.
    """
    rows = df.withColumn(stratum, F.coalesce(stratum, F.lit("Unknown")))
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("__size"))
    every = Window.partitionBy()
    share = F.floor(F.lit(limit) * F.col("__size") / F.sum("__size").over(every)) if mode == "prop" else F.floor(F.lit(limit) / F.count("*").over(every))
    quotas = sizes.withColumn("__quota", F.greatest(F.lit(1).cast("long"), share)).withColumn("__taken", F.least("__quota", "__size"))
    before = F.coalesce(F.sum("__taken").over(Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = quotas.select(stratum, F.least(F.col("__taken"), F.greatest(F.lit(limit) - before, F.lit(0))).alias("__take"))
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))).where(F.col("__n") <= limit)
    return ranked.join(quotas, stratum).where(F.col("__n") <= F.col("__take")).drop("__n", "__take")


def strata_counts(sample: DataFrame, stratum: str) -> DataFrame:
    return sample.groupBy(stratum).agg(F.count("*").alias("n")).orderBy(F.desc("n"), stratum)

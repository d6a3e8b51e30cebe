"""Set operations on id tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def missing_ids(everything: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return everything.select(key).subtract(done.select(key))


def resume(cells: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Cells that are not done yet."""
    return cells.join(done.select(key).distinct(), key, "left_anti")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def reconcile(everything: DataFrame, valid: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """One row: numbers of all, valid, rejected, done, missing and doubly done ids; each table is read once."""
    tagged = everything.select(key, F.lit("a").alias("t")).union(valid.select(key, F.lit("v"))).union(rejected.select(key, F.lit("r")))
    has = lambda t: F.max(F.when(F.col("t") == t, 1).otherwise(0))
    count = lambda t: F.count(F.when(F.col("t") == t, 1))
    by_id = tagged.groupBy(key).agg(has("a").alias("in_all"), has("v").alias("in_valid"), has("r").alias("in_rejected"), count("v").alias("n_v"), count("r").alias("n_r"))
    done = (F.col("in_valid") + F.col("in_rejected")) > 0
    return by_id.agg(
        F.sum("in_all").alias("n_all"), F.sum("n_v").alias("n_valid"), F.sum("n_r").alias("n_rejected"), F.count(F.when(done, 1)).alias("n_done"),
        F.count(F.when((F.col("in_all") == 1) & ~done, 1)).alias("n_missing"), (F.sum("n_v") + F.sum("n_r") - F.count(F.when(done, 1))).alias("n_duplicates"),
    )


def class_list(*ranges: tuple[int, int]) -> Column:
    """Codes of several closed ranges as one array."""
    return F.concat(*[F.sequence(F.lit(a), F.lit(b)) for a, b in ranges])

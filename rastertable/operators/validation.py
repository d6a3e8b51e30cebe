"""Checks of results: agreement of two methods, expected against found classes, bounds and shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def side_by_side(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Full outer join of two methods' rows: a_<column>, b_<column>, and match, which holds if all columns agree (null with null)."""
    left = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return left.join(right, key, "full_outer").withColumn("match", same)


def agreement(pairs: DataFrame) -> DataFrame:
    """One row: how many pairs agree and disagree."""
    return pairs.agg(F.count(F.when(F.col("match"), 1)).alias("n_agree"), F.count(F.when(~F.col("match"), 1)).alias("n_disagree"))


def confusion(df: DataFrame, expected: str, found: str, classes: Sequence[int]) -> DataFrame:
    """Rows of each expected class by found class."""
    counts = [F.count(F.when(F.col(found) == c, 1)).alias(f"found_{c}") for c in classes]
    return df.groupBy(expected).agg(*counts)


def violations(df: DataFrame, bounded: Column, bound: Column) -> DataFrame:
    """Rows in which a part is larger than its whole."""
    return df.where(bounded > bound)


def shape_check(tiles: DataFrame, extent: DataFrame, key: str = "aoi_id") -> DataFrame:
    """For each AOI whether its tiles fill the grid that its extent asks for: n_rows * n_cols distinct places."""
    counts = tiles.groupBy(key).agg(F.count_distinct("xi", "yi").alias("n_tiles"))
    return extent.join(counts, key, "left").withColumn("complete", F.coalesce("n_tiles", F.lit(0)) == F.col("n_rows") * F.col("n_cols"))

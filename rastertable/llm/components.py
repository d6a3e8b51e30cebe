"""Connected components of a link table, by star contraction on Spark joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertable.llm.shared import written

#: A key with more than this share of all rows is hot; there are at most ``HOT`` of them.
HOT = 256


def split_join(many: DataFrame, few: DataFrame, key: str, spread: str | Column, total: int, counts: DataFrame | None = None) -> DataFrame:
    """``many`` inner joined with ``few``, which has one row a key, on ``key``; hot keys are split.

    A key with more than 1 / ``HOT`` of the ``total`` rows (at least as many as ``many`` has) is split into parts of about that
    size by the hash of ``spread``, and its row of ``few`` is copied to each part. ``counts`` (key, __n), if known, spares counting.
    """
    share = total // HOT + 1
    counts = many.groupBy(key).agg(F.count("*").alias("__n")) if counts is None else counts
    hot = F.broadcast(counts.where(F.col("__n") > share).select(key, F.ceil(F.col("__n") / share).cast("int").alias("__parts")))  # at most HOT rows
    parts = F.coalesce("__parts", F.lit(1))
    left = many.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("__parts")
    right = few.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [key, "__part"]).drop("__part")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node that has a link; root is the least node of its component.

    Alternates the large-star and small-star steps until the table of stars no longer changes, which takes a number of
    rounds that grows with the logarithm of the longest path. Each step is an aggregation that combines before its shuffle
    and a join that splits hot nodes, so a node with very many links is no obstacle. Self-links and nulls are ignored;
    no links give no rows.
    """
    stars = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    state = lambda: tuple(stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first())
    now, seen = state(), None
    while now != seen:
        near, total = _both(stars), 2 * now[0]
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = split_join(near.where("v > u"), least, "u", "v", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, low, "u", "v", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        stars = written(small, "stars")
        now, seen = state(), now
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Answers that can be merged: quantile and distinct sketches by group, stored and added up without the rows.

A group's row has exact counts, sums and extremes, a KLL sketch of the values and an HLL sketch of the ids. Sketches of any groups can be
merged, so a report over any window reads one small row for each group and never the observations. Quantiles are within ``RANK_ERROR`` of
the asked rank, distinct counts within ``DISTINCT_ERROR`` (three standard errors); ``aggregates.quantiles`` and ``countDistinct`` are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that a KLL sketch keeps on its levels; and the bound on the rank error that follows.
KLL = 800
RANK_ERROR = 0.005
#: Bits of an HLL sketch's register number.
HLL = 14
DISTINCT_ERROR = 3 * 1.04 / 2 ** (HLL / 2)


def sketched(df: DataFrame, by: Sequence[str], column: str, ident: str) -> DataFrame:
    """(by, n, total, least, most, values_sketch, ids_sketch) for each group; rows without a value count for the ids alone."""
    v = F.col(column).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_double(v, F.lit(KLL)).alias("values_sketch"), F.hll_sketch_agg(ident, HLL).alias("ids_sketch"))


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same for coarser groups (none: all rows), from the sketches of finer ones."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("values_sketch", F.lit(KLL)).alias("values_sketch"), F.hll_union_agg("ids_sketch").alias("ids_sketch"))


def report(sketches: DataFrame, by: Sequence[str], q: Mapping[str, float]) -> DataFrame:
    """(by, n, mean, least, most, n_distinct) and a column for each quantile of ``q``; groups without values have null quantiles."""
    of = {name: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("values_sketch", F.lit(float(p)))) for name, p in q.items()}
    return sketches.select(*by, "n", (F.col("total") / F.nullif("n", F.lit(0))).alias("mean"), "least", "most", F.hll_sketch_estimate("ids_sketch").alias("n_distinct"), *[c.alias(k) for k, c in of.items()])

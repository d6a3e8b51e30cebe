"""Report aggregates: counts, shares, funnels, distributions, correlations and audits."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertable.functions.scalars import gain_area, pct
from rastertable.sources.workdir import kept


def group_count(df: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    """Rows of each group, most first, then by key."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def rejection_counts(df: DataFrame, reason: str = "rejection_reason", rejected: Column | None = None) -> DataFrame:
    """Rows by reason, with per cent of the rejected and of all rows; the total is one row."""
    hit = F.col(reason).isNotNull() if rejected is None else rejected & F.col(reason).isNotNull()
    total = df.agg(F.count("*").alias("total"), F.count(F.when(hit, 1)).alias("rejected"))
    counts = df.where(hit).groupBy(reason).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total), F.lit(True)).select(reason, "n", pct(F.col("n"), F.col("rejected")).alias("pct_rejected"), pct(F.col("n"), F.col("total")).alias("pct_total"))


def contribution(df: DataFrame, key: str, valid: str = "valid", area: str = "area_km2", fraction: str = "forest_gain_frac") -> DataFrame:
    """For each group: valid and rejected rows and gain areas, rejection rate and gain retention in per cent."""
    ok, gain = F.col(valid), gain_area(F.col(area), F.col(fraction))
    out = df.groupBy(key).agg(
        F.count(F.when(ok, 1)).alias("n_valid"), F.count(F.when(~ok, 1)).alias("n_rejected"),
        F.coalesce(F.sum(F.when(ok, gain)), F.lit(0.0)).alias("gain_valid"), F.coalesce(F.sum(F.when(~ok, gain)), F.lit(0.0)).alias("gain_rejected"),
    )
    return out.withColumns({"rejection_rate": pct(F.col("n_rejected"), F.col("n_valid") + F.col("n_rejected")), "gain_retention": pct(F.col("gain_valid"), F.col("gain_valid") + F.col("gain_rejected"))})


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Rows of ``row`` by the named values of ``column``, 0 where there is none; naming the values spares a pass over the data."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0)


def value_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, __v, __c, __part): how often each group has each value, written in ranges of keys and value, so that it is read more than once."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    return kept(counts.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()), "quantiles")


def quantiles(df: DataFrame, keys: Sequence[str], column: str, q: Mapping[str, float], floor: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """The keys, n and a column for each quantile of ``q`` over the rows of each group that have a value.

    Neighbouring values are interpolated; for names in ``floor`` it is the element at floor(n * q). Values are counted before the shuffle, dealt in ranges and numbered by the sums of the ranges before, so that no task holds a group or a column. ``counts`` are the ``value_counts``, if there already.
    """
    keys = list(keys)
    dealt = value_counts(df, keys, column) if counts is None else counts
    sums = dealt.groupBy(*keys, "__part").agg(F.sum("__c").alias("__s"))
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, "__part", F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__base"), F.sum("__s").over(Window.partitionBy(*keys)).alias("__n"))
    same = F.lit(True)
    for k in [*keys, "__part"]:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    before = Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__own", F.coalesce(F.sum("__c").over(before), F.lit(0))).alias("a").join(bases.alias("b"), same)
    rows = placed.select(*[F.col(f"a.{k}").alias(k) for k in keys], "__v", "__n", (F.col("__base") + F.col("__own")).alias("__at"), "__c")
    at = lambda p: F.max(F.when((F.col("__at") <= p) & (p < F.col("__at") + F.col("__c")), F.col("__v")))
    out = {}
    for name, share in q.items():
        if name in floor:
            out[name] = at(F.floor(F.col("__n") * share))
        else:
            place = (F.col("__n") - 1) * share
            lo, hi = at(F.floor(place)), at(F.ceil(place))
            out[name] = lo + (hi - lo) * F.max(place - F.floor(place))
    return rows.groupBy(*keys).agg(F.max("__n").alias("n"), *[c.alias(k) for k, c in out.items()])


def summary_stats(df: DataFrame, column: str) -> DataFrame:
    """n, min, p25, mean, median, p75, max and stdev (0 for one value) of a column.

    Quartiles are elements at floor(n * q) of the sorted values, without interpolation; the median is interpolated.
    """
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull())
    one = rows.agg(F.count("*").alias("n"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.when(F.count("*") > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("stdev"))
    ranks = quantiles(rows, [], column, {"p25": 0.25, "median": 0.5, "p75": 0.75}, floor=("p25", "p75")).drop("n")
    return one.join(F.broadcast(ranks), F.lit(True)).select("n", "min", "p25", "mean", "median", "p75", "max", "stdev")  # one row each


def extent(df: DataFrame, lon: str, lat: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"), F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"))


def gain_totals(df: DataFrame, gain: str, *keys: str) -> DataFrame:
    """Total, rows above 0 and their per cent, mean."""
    out = df.groupBy(*keys).agg(F.sum(gain).alias("total"), F.count(F.when(F.col(gain) > 0, 1)).alias("nonzero"), F.count("*").alias("n"), F.avg(gain).alias("mean"))
    return out.withColumn("nonzero_pct", pct(F.col("nonzero"), F.col("n")))


def funnel(df: DataFrame, stages: Sequence[str], reason: str = "rejection_reason") -> DataFrame:
    """(step, stage, remaining): rows left after each stage; ``stages`` are the reasons in their order."""
    left = [F.count("*")] + [F.count(F.when(~F.col(reason).isin(*stages[: k + 1]), 1)) for k in range(len(stages))]
    names = ["start", *stages]
    one = df.agg(*[c.alias(f"s{k}") for k, c in enumerate(left)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("stage"), F.col(f"s{k}").alias("remaining")) for k, n in enumerate(names)])))


def histogram(df: DataFrame, column: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(bin, n, density) of equal widths from the least to the largest value, which falls in the last bin."""
    c = F.col(column).cast("double")
    ends = df.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"), F.count(c).alias("__n"))
    low, high = (F.col("__lo") if lo is None else F.lit(float(lo))), (F.col("__hi") if hi is None else F.lit(float(hi)))
    width = (high - low) / bins
    place = F.when(width > 0, F.least(F.floor((c - low) / width), F.lit(bins - 1).cast("long"))).otherwise(0)
    counted = df.where(c.isNotNull()).join(F.broadcast(ends), F.lit(True)).where(c.between(low, high)).groupBy(place.alias("bin"), width.alias("__w"), "__n").agg(F.count("*").alias("n"))
    return counted.select("bin", "n", F.try_divide(F.col("n"), F.col("__n") * F.col("__w")).alias("density"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r, n) of each pair, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)], *[F.count(F.when(both(a, b), 1)).alias(f"n{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r"), F.col(f"n{k}").alias("n")) for k, (a, b) in enumerate(pairs)])))


def _two_sided(t: float, df: float) -> float:
    """P(|T| > t) of Student's distribution: the regularised incomplete beta at df / (df + t^2), by Lentz's continued fraction."""
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        out = d
        for m in range(1, 300):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + step * d, 1 + step / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                out *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def corr_pvalue(matrix: DataFrame) -> DataFrame:
    """Adds p (two-sided) and stars at .05, .01, .001 to a correlation matrix; p is 0 for |r| >= 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            p = [None if pd.isna(r) or n < 3 else 0.0 if abs(r) >= 1 else _two_sided(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2) for r, n in zip(rows.r, rows.n, strict=True)]
            yield rows.assign(p=pd.Series(p, dtype="float64", index=rows.index))

    out = matrix.mapInPandas(run, "a string, b string, r double, n long, p double")
    return out.withColumn("stars", F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise(""))


def boxplot_stats(df: DataFrame, key: str, column: str) -> DataFrame:
    """Quartiles, whiskers (the farthest values within 1.5 interquartile ranges) and mean by group, largest median first."""
    counts = value_counts(df, [key], column)  # holds all that is needed, so the rows are read once
    q = quantiles(df, [key], column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, counts=counts).where(F.col(key).isNotNull())
    reach, v = 1.5 * (F.col("q3") - F.col("q1")), F.col("__v")
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    spread = counts.join(q, key).groupBy(key).agg((F.sum(v * F.col("__c")) / F.sum("__c")).alias("mean"), F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"))
    return q.join(spread, key).select(key, "q1", "median", "q3", "mean", "n", "whisker_lo", "whisker_hi").orderBy(F.desc("median"), key)


def tiles_per_aoi(links: DataFrame, aoi: str = "aoi_id") -> DataFrame:
    per = kept(links.groupBy(aoi).agg(F.count("*").alias("n")), "tiles-per-aoi")
    one = per.agg(F.count("*").alias("aois"), F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"))
    return one.join(F.broadcast(quantiles(per, [], "n", {"median": 0.5}).drop("n")), F.lit(True))  # one row


def latitude_load(tiles: DataFrame, aoi: str, lat: Column) -> DataFrame:
    """Tiles, mean latitude and tiles times the cosine of latitude, for each AOI."""
    out = tiles.groupBy(aoi).agg(F.count("*").alias("n"), F.avg(lat).alias("lat"))
    return out.withColumn("scaled", F.col("n") * F.cos(F.radians("lat")))


def status_map(tiles: DataFrame, aoi: str = "aoi_id", complete: str = "complete") -> DataFrame:
    """For each AOI a map from status to count, total, complete tiles and whether there are any; statuses are few."""
    counts = tiles.groupBy(aoi, "status").agg(F.count("*").alias("n"))
    out = counts.groupBy(aoi).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("tile_counts"), F.sum("n").alias("total_tiles"), F.coalesce(F.sum(F.when(F.col("status") == complete, F.col("n"))), F.lit(0)).alias("complete_tiles"))
    return out.withColumn("has_coverage", F.col("complete_tiles") > 0)


def coverage_by(audit: DataFrame, key: str = "biome") -> DataFrame:
    """AOIs, covered AOIs and the gap in per cent by group, most AOIs first."""
    out = audit.groupBy(key).agg(F.count("*").alias("total"), F.count(F.when(F.col("has_coverage"), 1)).alias("covered"))
    return out.withColumn("gap_pct", pct(F.col("total") - F.col("covered"), F.col("total"))).orderBy(F.desc("total"), key)


def shares(df: DataFrame, set_key: str, key: str) -> DataFrame:
    """Rows of each group and their per cent of the set."""
    counts = df.groupBy(set_key, key).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy(set_key))))


def running_share(groups: DataFrame, key: str, value: str) -> DataFrame:
    """Cumulative per cent, the largest first; ``groups`` has one row for each group, so the ordered window is small."""
    up = Window.orderBy(F.desc(value), key).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    return groups.withColumn("running_pct", pct(F.sum(value).over(up), F.sum(value).over(total)))


def top_n(df: DataFrame, n: int, by: Sequence[Column], *keys: str) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("__n") <= n).drop("__n")


def category_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """Adds a code from 1 in sorted order of the distinct values; only these are ranked."""
    known = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(code, F.dense_rank().over(Window.orderBy(column)))
    return df.join(known, column, "left")


def last_write_wins(cells: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """For each cell the value of its last record."""
    return cells.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def plan_summary(tiles: DataFrame) -> DataFrame:
    """(dimension, value, n, pct): all tiles, by biome and by region, in one pass of grouping sets."""
    counts = tiles.groupingSets([["biome"], ["region"], []], "biome", "region").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 1, "biome").when(F.col("g") == 2, "region").otherwise("all")
    out = counts.select(dimension.alias("dimension"), F.coalesce(F.when(F.col("g") == 1, F.col("biome")), F.when(F.col("g") == 2, F.col("region")), F.lit("")).alias("value"), "n")
    return out.withColumn("pct", pct(F.col("n"), F.max(F.when(F.col("dimension") == "all", F.col("n"))).over(Window.partitionBy())))


def run_tally(tiles: DataFrame, aoi: str = "aoi_id", states: Mapping[str, str] | None = None) -> DataFrame:
    """Tiles of each state by AOI, and over all (a null AOI)."""
    states = states or {"valid": "n_valid", "rejected": "n_rejected", "failed": "n_failed"}
    return tiles.rollup(aoi).agg(*[F.count(F.when(F.col("status") == s, 1)).alias(n) for s, n in states.items()])

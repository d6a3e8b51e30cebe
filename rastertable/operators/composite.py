"""Scans and composites over an observation table: one row for each scene and pixel, one column for each band."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastertable.functions.pixels import REDUCERS, all_valid, scl_valid
from rastertable.sources.workdir import kept

PIXEL = ("gx", "gy")


def year_window(year: int, whole: bool = False) -> tuple[str, str]:
    """Half-open date window of a year; without ``whole`` the last day of December is outside."""
    return f"{year}-01-01", f"{year + 1}-01-01" if whole else f"{year}-12-31"


def in_window(ts: Column, start: str | date, end: str | date) -> Column:
    return (ts >= F.lit(str(start)).cast("timestamp")) & (ts < F.lit(str(end)).cast("timestamp"))


def overlaps(df: DataFrame, bbox: tuple[float, float, float, float], cols: Sequence[str] = ("min_lon", "min_lat", "max_lon", "max_lat")) -> DataFrame:
    """Rows whose box meets ``bbox`` (edges touch)."""
    x0, y0, x1, y1 = cols
    return df.where((F.col(x0) <= bbox[2]) & (F.col(x1) >= bbox[0]) & (F.col(y0) <= bbox[3]) & (F.col(y1) >= bbox[1]))


def scan_scenes(obs: DataFrame, start: str, end: str, gx: tuple[int, int] | None = None, gy: tuple[int, int] | None = None, metadata: Column | None = None, ts: str = "ts") -> DataFrame:
    """Observations of a half-open time window, of a half-open pixel box and with scene metadata that holds.

    All are plain comparisons on columns, so they reach the Parquet scan.
    """
    out = obs.where(in_window(F.col(ts), start, end))
    for c, span in (("gx", gx), ("gy", gy)):
        if span:
            out = out.where((F.col(c) >= span[0]) & (F.col(c) < span[1]))
    return out if metadata is None else out.where(metadata)


def meta_below(column: str, most: float) -> Column:
    return F.col(column) < most


def list_contains(column: str, *values: str) -> Column:
    """Whether a metadata list has all of ``values``."""
    out = F.lit(True)
    for v in values:
        out = out & F.array_contains(column, v)
    return out


def _by_pixel(obs: DataFrame, aggregates: dict[str, Column], by: Sequence[str]) -> DataFrame:
    return obs.groupBy(*PIXEL, *by).agg(*[c.alias(k) for k, c in aggregates.items()])


def percentile_composite(obs: DataFrame, bands: Sequence[str], p: float = 0.25, by: Sequence[str] = ("y",), accuracy: int | None = None) -> DataFrame:
    """The percentile of each band over a pixel's scenes; exact and interpolated, or approximate with ``accuracy`` for deep stacks."""
    f = (lambda b: F.percentile(b, p)) if accuracy is None else (lambda b: F.percentile_approx(b, p, accuracy))
    return _by_pixel(obs, {b: f(b) for b in bands}, by)


def median_composite(obs: DataFrame, bands: Sequence[str], by: Sequence[str] = ("y",)) -> DataFrame:
    return _by_pixel(obs, {b: F.median(b) for b in bands}, by)


def mean_composite(obs: DataFrame, bands: Sequence[str], by: Sequence[str] = ("y",)) -> DataFrame:
    """Mean of each band; a pixel without any value gets 0."""
    return _by_pixel(obs, {b: F.coalesce(F.avg(b), F.lit(0.0)) for b in bands}, by)


def mode_composite(obs: DataFrame, band: str, by: Sequence[str] = ("y",)) -> DataFrame:
    """The most frequent class, the smallest if equal."""
    return _by_pixel(obs, {band: F.mode(band, deterministic=True)}, by)


def wide_composite(obs: DataFrame, years: Mapping[int, str], bands: Mapping[str, tuple[Column, str]], year: str = "y") -> DataFrame:
    """Several composites of several years at once: a column <band><suffix> for each band (column, reducer name) and year suffix.

    All aggregates share one shuffle of the observations on the pixel; years are told apart inside the aggregates.
    """
    own = obs.where(F.col(year).isin(*years))
    return own.groupBy(*PIXEL).agg(*[REDUCERS[r](F.when(F.col(year) == y, c)).alias(f"{b}{s}") for y, s in years.items() for b, (c, r) in bands.items()])


#: Pixels of the side of a block whose scenes one group of ``block_quantiles`` holds as arrays.
SIDE = 16
#: Rows of a block, at most, that one group holds.
BLOCK_ROWS = 1 << 20


def block_quantiles(obs: DataFrame, years: Mapping[int, str], bands: Mapping[str, float], year: str = "y", side: int = SIDE, most: int = BLOCK_ROWS) -> DataFrame:
    """For each pixel a column <prefix><band> for every year (by its prefix) and band: the interpolated quantile of the band's values.

    ``obs`` may be a union of tables that have some of the bands each. Scenes are dealt to blocks of pixels in one shuffle; within a block each
    band is put in order once, by pixel, year and value, and the quantiles are picked along the scenes. Pixels without a value have null.
    Blocks of over ``most`` rows are no group: their values are counted before the shuffle, by pixel, and the same quantiles taken from the counts.
    """
    names = [f"{p}{b}" for p in years.values() for b in bands]
    kinds = [obs.schema[c].dataType for c in PIXEL]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(PIXEL, kinds, strict=True)] + [T.StructField(n, T.DoubleType()) for n in names])
    order = np.array(list(years), np.int64)
    rank = np.argsort(order)
    own = obs.where(F.col(year).isin(*years)).select(*PIXEL, F.col(year).cast("long").alias("__y"), *[F.col(b).cast("double").alias(b) for b in bands])
    dealt = own.withColumns({"__bx": F.floor(F.col(PIXEL[0]) / side), "__by": F.floor(F.col(PIXEL[1]) / side)})

    def run(rows: pa.Table) -> pa.Table:
        x, y = (rows.column(c).to_numpy() for c in PIXEL)
        low_x, low_y = x.min(), y.min()
        place = (x - low_x).astype(np.int64) * side + (y - low_y).astype(np.int64)
        there, pixel = np.unique(place, return_inverse=True)
        slot = pixel * len(order) + rank[np.searchsorted(order[rank], rows.column("__y").to_numpy())]
        found = {}
        for b, p in bands.items():
            column = rows.column(b).combine_chunks()
            held = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False))
            value, at = column.to_numpy(zero_copy_only=False)[held], slot[held]
            by = np.lexsort((value, at))
            value, at = value[by], at[by]
            n = np.bincount(at, minlength=len(there) * len(order))
            first = np.cumsum(n) - n
            has = np.flatnonzero(n)
            spot = (n[has] - 1) * p
            low = np.floor(spot).astype(np.int64)
            a, c = value[first[has] + low], value[first[has] + np.ceil(spot).astype(np.int64)]
            out = np.full(len(n), np.nan)
            out[has] = a + (c - a) * (spot - low)
            found[b] = out.reshape(len(there), len(order)), n.reshape(len(there), len(order)) == 0
        columns = [pa.array((there // side + low_x).astype(x.dtype)), pa.array((there % side + low_y).astype(y.dtype))]
        for k in range(len(order)):
            columns += [pa.array(found[b][0][:, k], mask=found[b][1][:, k]) for b in bands]
        return pa.Table.from_arrays(columns, names=[*PIXEL, *names])

    full = kept(dealt.groupBy("__bx", "__by").agg(F.count("*").alias("__n")).where(F.col("__n") > most).select("__bx", "__by"), "full-blocks")
    if full.isEmpty():
        return dealt.groupBy("__bx", "__by").applyInArrow(run, schema)
    usual = dealt.join(full, ["__bx", "__by"], "left_anti").groupBy("__bx", "__by").applyInArrow(run, schema)
    value = lambda y, b: F.when(F.col("__y") == y, F.col(b))
    picked = [F.percentile(value(y, b), p).alias(f"{prefix}{b}") for y, prefix in years.items() for b, p in bands.items()]
    counted = dealt.join(full, ["__bx", "__by"], "left_semi").groupBy(*PIXEL).agg(*picked)
    return usual.unionByName(counted)


def availability(obs: DataFrame, bands: Sequence[str], by: Sequence[str] = ("y",), scl: str | None = None) -> DataFrame:
    """1 if some observation of the pixel has every band (and, with ``scl``, a usable scene class)."""
    ok = all_valid(*map(F.col, bands))
    if scl:
        ok = F.when(scl_valid(F.col(scl)), ok).otherwise(0)
    return _by_pixel(obs, {"available": F.max(ok)}, by)


def full_valid(available: DataFrame, years: Sequence[int], year: str = "y") -> DataFrame:
    """Pixels that are available in all of ``years``; a year without a row counts as 0."""
    hits = available.where(F.col(year).isin(*years) & (F.col("available") == 1)).groupBy(*PIXEL).agg(F.count_distinct(year).alias("n"))
    return hits.where(F.col("n") == len(years)).select(*PIXEL, F.lit(1).alias("full_valid"))


def mosaic(scenes: DataFrame, bands: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One value for each pixel and band: that of the last scene, by ``order``, which has the band."""
    rank = F.struct(*order)
    return scenes.groupBy(*PIXEL).agg(*[F.max_by(b, F.when(F.col(b).isNotNull(), rank)).alias(b) for b in bands])


def seasonal_window(lat: Column, year: int) -> tuple[Column, Column]:
    """Start and end (exclusive) of the growing season: May to September in the north, November to March in the south."""
    north = lat > 0
    start = F.when(north, F.make_date(F.lit(year), F.lit(5), F.lit(1))).otherwise(F.make_date(F.lit(year), F.lit(11), F.lit(1)))
    end = F.when(north, F.make_date(F.lit(year), F.lit(9), F.lit(30))).otherwise(F.make_date(F.lit(year + 1), F.lit(3), F.lit(31)))
    return start, end


def in_season(obs: DataFrame, zones: DataFrame, on: str | list[str], year: int, lat: str = "lat", ts: str = "ts") -> DataFrame:
    """Observations that fall in their zone's season; an equi-join on the zone, the interval is a residual condition."""
    start, end = seasonal_window(F.col(lat), year)
    windows = zones.select(*([on] if isinstance(on, str) else on), start.alias("__start"), end.alias("__end"))
    return obs.join(windows, on).where((F.col(ts) >= F.col("__start")) & (F.col(ts) < F.col("__end"))).drop("__start", "__end")


def complete_domain(domain: DataFrame, layer: DataFrame) -> DataFrame:
    """All pixels of ``domain``; those without a row in ``layer`` have masked bands."""
    return domain.select(*PIXEL).join(layer, list(PIXEL), "left")


def linear_trend(yearly: DataFrame, band: str, year: str = "y") -> DataFrame:
    """Slope and population deviation of a pixel's yearly values; the slope is bounded to 0..1 in ``trend``."""
    slope = F.regr_slope(F.col(band), F.col(year).cast("double"))
    out = yearly.groupBy(*PIXEL).agg(slope.alias("slope"), F.stddev_pop(band).alias("std"), F.count(band).alias("n_years"))
    return out.withColumn("trend", F.when(F.col("slope").isNotNull(), F.least(F.greatest("slope", F.lit(0.0)), F.lit(1.0))))


def trend_moments(yearly: DataFrame, band: str, year: str = "y", by: Sequence[str] = PIXEL) -> DataFrame:
    """(by, n, mt, mv, tt, tv, vv): number, means and sums of products of differences from the means of each pixel's yearly values.

    These can be kept and merged, so a new year needs no old observation.
    """
    v = F.col(band).cast("double")
    t = F.when(v.isNotNull(), F.col(year).cast("double"))
    n = F.count(v)
    return yearly.groupBy(*by).agg(n.alias("n"), F.avg(t).alias("mt"), F.avg(v).alias("mv"), (F.var_pop(t) * n).alias("tt"), (F.covar_pop(t, v) * n).alias("tv"), (F.var_pop(v) * n).alias("vv")).where("n > 0")


def merge_trends(parts: DataFrame, by: Sequence[str] = PIXEL) -> DataFrame:
    """One row of moments a pixel from several over different years; a pixel has as many as it has parts. Differences are joined, so no digits are lost."""
    fields = ("n", "mt", "mv", "tt", "tv", "vv")
    rows = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__p"))

    def joined(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        dt, dv, both = b["mt"] - a["mt"], b["mv"] - a["mv"], a["n"] * b["n"] / n
        return F.struct(n.alias("n"), (a["mt"] + dt * b["n"] / n).alias("mt"), (a["mv"] + dv * b["n"] / n).alias("mv"), (a["tt"] + b["tt"] + dt * dt * both).alias("tt"), (a["tv"] + b["tv"] + dt * dv * both).alias("tv"), (a["vv"] + b["vv"] + dv * dv * both).alias("vv"))

    one = F.aggregate(F.slice("__p", 2, F.size("__p")), F.element_at("__p", 1), joined)
    return rows.select(*by, one.alias("__m")).select(*by, *[F.col(f"__m.{c}").alias(c) for c in fields])


def trend_of(moments: DataFrame, by: Sequence[str] = PIXEL) -> DataFrame:
    """What ``linear_trend`` gives, from moments."""
    slope = F.when(F.col("tt") > 0, F.col("tv") / F.nullif(F.col("tt"), F.lit(0.0)))
    out = moments.select(*by, slope.alias("slope"), F.sqrt(F.col("vv") / F.col("n")).alias("std"), F.col("n").alias("n_years"))
    return out.withColumn("trend", F.when(F.col("slope").isNotNull(), F.least(F.greatest("slope", F.lit(0.0)), F.lit(1.0))))


def last_per_pixel(obs: DataFrame, order: Sequence[str]) -> DataFrame:
    """The whole last observation of each pixel."""
    w = Window.partitionBy(*PIXEL).orderBy(*[F.col(c).desc() for c in order])
    return obs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

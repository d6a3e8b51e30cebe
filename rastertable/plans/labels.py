"""Gain layer, time-step bands, pseudo labels, the full stack and viability."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertable.functions.pixels import OPTICAL_BANDS, above, and_, argmax_band, band_ratio, clamp, confidence, evi, geo_mean, ndvi, not_, self_mask
from rastertable.operators import neighbor, zonal
from rastertable.operators.composite import block_quantiles, linear_trend

# Fixed value: per cent of cover above which a pixel is forest.
FOREST_COVER = 50.0
STEP_BANDS = (*OPTICAL_BANDS, "NDVI", "EVI", "VV", "VH", "VVVH", "trees", "crops", "built")
LABEL_BANDS = ("score_agrocrop", "score_nat_regen", "score_plantation", "score_restoration", "dominant", "confidence")


def gain_layer(cover: DataFrame, before: str = "cover_2017", after: str = "cover_2020", trees: str = "trees", mode: str = "zero") -> DataFrame:
    """Adds validated (masked outside forest gain) and gain (0/1): no forest before, forest after, closed, and trees on the map."""
    raw = and_(not_(above(F.col(before), FOREST_COVER)), above(F.col(after), FOREST_COVER))
    clean = neighbor.close(cover.withColumn("__gain", F.coalesce(raw, F.lit(0))), "__gain", "__clean", mode)
    validated = and_(F.col("__clean"), F.coalesce(trees, F.lit(0)))
    return clean.withColumn("gain", F.coalesce(validated, F.lit(0))).withColumn("validated", self_mask(F.col("gain"))).drop("__gain", "__clean")


def timestep_stacks(optical: DataFrame, radar: DataFrame, land: DataFrame, steps: Mapping[int, str], domain: DataFrame | None = None, cloudy: float = 30.0) -> DataFrame:
    """15 bands for each year of ``steps`` with that year's name prefix: 25th percentiles of the optical bands and indices, medians of radar and land cover.

    ``optical``: gx, gy, y, cloudy_pct and the bands; ``radar``: VV, VH; ``land``: trees, crops, built. Each table is read and shuffled once for
    all years: a year's aggregate is over the values of that year.
    """
    indexed = optical.where(F.col("cloudy_pct") < cloudy).withColumns({"NDVI": ndvi(F.col("B8"), F.col("B4")), "EVI": evi(F.col("B8"), F.col("B4"), F.col("B2"))})

    def wide(df: DataFrame, bands: Sequence[str], reducer: Callable[[Column], Column]) -> DataFrame:
        own = df.where(F.col("y").isin(*steps))
        return own.groupBy("gx", "gy").agg(*[reducer(F.when(F.col("y") == y, F.col(b))).alias(f"{p}{b}") for y, p in steps.items() for b in bands])

    a = wide(indexed, [*OPTICAL_BANDS, "NDVI", "EVI"], lambda c: F.percentile(c, 0.25))
    b = wide(radar, ["VV", "VH"], F.median)
    c = wide(land, ["trees", "crops", "built"], F.median)
    out = zonal.align(a, b, c, how="full_outer") if domain is None else zonal.align(domain.select("gx", "gy"), a, b, c)
    out = out.withColumns({f"{p}VVVH": band_ratio(F.col(f"{p}VV"), F.col(f"{p}VH")) for p in steps.values()})
    return out.select("gx", "gy", *[f"{p}{band}" for p in steps.values() for band in STEP_BANDS])


def timestep_blocks(optical: DataFrame, radar: DataFrame, land: DataFrame, steps: Mapping[int, str], domain: DataFrame | None = None, cloudy: float = 30.0) -> DataFrame:
    """What ``timestep_stacks`` gives, by blocks of pixels: the three tables are one union, dealt in one shuffle, and no wide joins follow."""
    quarter, middle = (*OPTICAL_BANDS, "NDVI", "EVI"), {"VV": radar, "VH": radar, "trees": land, "crops": land, "built": land}
    indexed = optical.where(F.col("cloudy_pct") < cloudy).withColumns({"NDVI": ndvi(F.col("B8"), F.col("B4")), "EVI": evi(F.col("B8"), F.col("B4"), F.col("B2"))})
    number = lambda df, bands: df.select("gx", "gy", "y", *[F.col(b).cast("double").alias(b) for b in bands])
    obs = number(indexed, quarter)
    for table in (radar, land):
        obs = obs.unionByName(number(table, [b for b, of in middle.items() if of is table]), allowMissingColumns=True)
    out = block_quantiles(obs, steps, dict.fromkeys(quarter, 0.25) | dict.fromkeys(middle, 0.5))
    out = out if domain is None else zonal.align(domain.select("gx", "gy"), out)
    out = out.withColumns({f"{p}VVVH": band_ratio(F.col(f"{p}VV"), F.col(f"{p}VH")) for p in steps.values()})
    return out.select("gx", "gy", *[f"{p}{band}" for p in steps.values() for band in STEP_BANDS])


def timestep_stack(optical: DataFrame, radar: DataFrame, land: DataFrame, year: int, prefix: str, domain: DataFrame | None = None, cloudy: float = 30.0) -> DataFrame:
    """The 15 bands of one year."""
    return timestep_stacks(optical, radar, land, {year: prefix}, domain, cloudy)


def label_scores() -> dict[str, Column]:
    """The four scores from the bands that ``pseudo_labels`` prepares; each is a geometric mean times a bounded bonus."""
    # The weights of the scores and the bounds of their bonuses.
    c = F.col
    bonus = lambda e: clamp(e, hi=2.0)
    return {
        "score_agrocrop": geo_mean(c("treecrop"), c("esa_crop")) * bonus(1 + 0.4 * c("crops_pre") + 0.4 * c("crops_post")),
        "score_nat_regen": geo_mean(c("nat_forest"), c("trees_pre")) * bonus(1 + 0.5 * c("jrc_natreg") + clamp(2 * c("dw_std"), hi=0.5)),
        "score_plantation": geo_mean(c("jrc_planted"), c("ch_uni")) * bonus(1 + 0.5 * c("low_nat") + 0.3 * c("trees_pre")),
        "score_restoration": geo_mean(c("jrc_planted"), c("ch_std"), c("low_nat")) * bonus(1 + 0.5 * c("dw_slope") + 0.3 * clamp(c("slope") / 30.0, hi=1.0)),
    }


def pseudo_labels(pixels: DataFrame, land: DataFrame, pre: int = 2017, post: int = 2020) -> DataFrame:
    """gx, gy and the six label bands.

    ``pixels``: gx, gy, gain, canopy, nat_forest, treecrop, esa_crop, forest_type and slope (static layers); ``land``: gx, gy, y, trees, crops
    (observations). Masked inputs count as 0; outside gain the canopy is 0 before its local deviation is taken.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    on_gain = pixels.withColumn("__canopy", F.when(F.col("gain") == 1, zero("canopy")).otherwise(0.0))
    canopy = neighbor.neighborhood_std(on_gain, "__canopy", "__std")
    yearly = land.where(F.col("y").between(pre, post)).groupBy("gx", "gy", "y").agg(F.avg("trees").alias("trees"), F.avg("crops").alias("crops"))
    trend = linear_trend(yearly, "trees").select("gx", "gy", F.col("trend").alias("dw_slope"), F.col("std").alias("dw_std"))
    at = lambda b, y: F.max(F.when(F.col("y") == y, F.col(b)))
    ends = yearly.groupBy("gx", "gy").agg(at("trees", pre).alias("trees_pre"), at("crops", pre).alias("crops_pre"), at("crops", post).alias("crops_post"))
    joined = zonal.align(canopy, trend, ends)
    ready = joined.select(
        "gx", "gy", clamp(zero("__std") / 10.0, hi=1.0).alias("ch_std"), (F.coalesce(F.col("forest_type") == 20, F.lit(False))).cast("double").alias("jrc_planted"), (F.coalesce(F.col("forest_type") == 1, F.lit(False))).cast("double").alias("jrc_natreg"),
        zero("nat_forest").alias("nat_forest"), (1 - zero("nat_forest")).alias("low_nat"), F.when(F.col("gain") == 1, zero("treecrop")).otherwise(0.0).alias("treecrop"), zero("esa_crop").alias("esa_crop"), zero("slope").alias("slope"),
        *[zero(b).alias(b) for b in ("dw_slope", "dw_std", "trees_pre", "crops_pre", "crops_post")],
    ).withColumn("ch_uni", 1 - F.col("ch_std"))
    scored = ready.select("gx", "gy", *[s.alias(k) for k, s in label_scores().items()])
    scores = [F.col(k) for k in LABEL_BANDS[:4]]
    return scored.withColumns({"dominant": argmax_band(*scores), "confidence": confidence(*scores)})


def full_stack(steps: Sequence[DataFrame], static: DataFrame, labels: DataFrame, valid: DataFrame) -> DataFrame:
    """All bands of the time steps, the static layers and the labels, on pixels that are available in all years.

    All inputs hash on (gx, gy); the inner join with ``valid`` comes first, so that masked pixels are dropped before the wide joins.
    """
    return zonal.align(zonal.align(valid.select("gx", "gy"), static, *steps), labels)


def viability(pixels: DataFrame, zones: Sequence[str]) -> DataFrame:
    """Median NDVI difference and mean canopy over each zone's gain pixels, 0 where there are none."""
    on_gain = lambda c: F.when(F.col("gain") == 1, F.col(c))
    return pixels.groupBy(*zones).agg(F.coalesce(F.median(on_gain("ndvi_delta")), F.lit(0.0)).alias("ndvi_delta"), F.coalesce(F.avg(on_gain("canopy")), F.lit(0.0)).alias("gain_canopy_mean"))


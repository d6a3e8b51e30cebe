"""Filters and decision rules. Each decision is one CASE expression; the first rule that holds gives the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertable.functions.pixels import NO_GAIN
from rastertable.functions.scalars import contains_ignoring_case

# Thresholds of the screening waterfall and of the tile decision.
MIN_LAND, MIN_VEG, MIN_GAIN, MIN_SCENES = 0.01, 0.01, 0.001, 0.05
GAIN_PCT_MIN, NDVI_DELTA_MIN, CANOPY_MIN, AVAILABLE_MIN = 1.0, 0.0, 1.0, 0.95
CHECK_YEARS = (2017, 2020, 2025)


def filter_candidates(tiles: DataFrame, status: str | None = None, aoi_id: str | None = None, biome: str | None = None, region: str | None = None) -> DataFrame:
    """Tiles with a status, of an AOI (column aoi_ids), and whose biome and region contain a text in any case; None: no filter."""
    out = tiles
    if status is not None:
        out = out.where(F.col("status") == status)
    if aoi_id is not None:
        out = out.where(F.array_contains("aoi_ids", aoi_id))
    if biome is not None:
        out = out.where(contains_ignoring_case(F.col("biome"), biome))
    return out if region is None else out.where(contains_ignoring_case(F.col("region"), region))


def waterfall_reason(stages: Sequence[tuple[str, Column]], passed: str = "valid") -> Column:
    """The name of the first stage whose test is not met, or ``passed``; a null test is not met."""
    out = None
    for name, ok in stages:
        failed = ~F.coalesce(ok, F.lit(False))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out.otherwise(passed)


def screening_stages(land: str = "land_frac", veg: str = "veg_fraction", gain: str = "forest_gain_frac", scenes: str = "s2_frac", limits: tuple[float, float, float, float] = (MIN_LAND, MIN_VEG, MIN_GAIN, MIN_SCENES)) -> list[tuple[str, Column]]:
    return list(zip(("no_land", "insufficient_veg", "no_forest_gain", "missing_s2"), [F.col(c) >= t for c, t in zip((land, veg, gain, scenes), limits, strict=True)], strict=True))


def waterfall(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds rejection_reason and valid."""
    out = df.withColumn("rejection_reason", waterfall_reason(stages))
    return out.withColumn("valid", F.col("rejection_reason") == "valid")


def reject_defaults(df: DataFrame, veg: str = "veg_fraction", gain: str = "forest_gain_frac", reason: str = "rejection_reason") -> DataFrame:
    """What a stage never measured is 0: vegetation without land, gain without land or vegetation."""
    r = F.col(reason)
    return df.withColumns({veg: F.when(r == "no_land", 0.0).otherwise(F.col(veg)), gain: F.when(r.isin("no_land", "insufficient_veg"), 0.0).otherwise(F.col(gain))})


def tile_decision(stats: DataFrame, available: Sequence[str], gain_min: float = GAIN_PCT_MIN, ndvi_min: float = NDVI_DELTA_MIN, canopy_min: float = CANOPY_MIN, available_min: float = AVAILABLE_MIN) -> DataFrame:
    """Adds status, reason_code and reason from gain_frac, ndvi_delta, canopy_mean and the availability columns."""
    gain, ndvi, canopy = F.col("gain_frac") * 100.0, F.col("ndvi_delta"), F.col("canopy_mean")
    low = F.lit(False)
    for c in available:
        low = low | (F.coalesce(F.col(c), F.lit(0.0)) < available_min)
    missing = ndvi.isNull() | canopy.isNull() | (ndvi == NO_GAIN) | (canopy == NO_GAIN)
    rules = [
        ("low_gain", F.coalesce(gain, F.lit(0.0)) < gain_min, F.format_string(f"gain_pct=%.3f < {gain_min}", F.coalesce(gain, F.lit(0.0)))),
        ("no_gain", missing, F.format_string("no_gain_pixels gain_pct=%.3f", gain)),
        ("viability", (ndvi <= ndvi_min) | (canopy < canopy_min), F.format_string("viability ndvi_delta=%.4f canopy_mean=%.3f", ndvi, canopy)),
        ("coverage", low, F.concat(F.lit("s2_coverage={"), F.concat_ws(", ", *[F.concat(F.lit(f"'{c[-4:]}': "), F.coalesce(F.col(c), F.lit(0.0)).cast("string")) for c in available]), F.lit("}"))),
    ]
    code = text = None
    for name, holds, words in rules:
        code = F.when(holds, name) if code is None else code.when(holds, name)
        text = F.when(holds, words) if text is None else text.when(holds, words)
    out = stats.withColumns({"reason_code": code.otherwise("valid"), "reason": text})
    return out.withColumn("status", F.when(F.col("reason_code") == "valid", "valid").otherwise("rejected"))


def single_checks(stats: DataFrame, available: Sequence[str]) -> DataFrame:
    """The three checks of one tile at a time, each by itself, nulls as 0: check_gain, check_viability, check_coverage."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    covered = F.lit(True)
    for c in available:
        covered = covered & (zero(c) >= AVAILABLE_MIN)
    return stats.withColumns({"check_gain": zero("gain_frac") * 100.0 >= GAIN_PCT_MIN, "check_viability": (zero("ndvi_delta") > NDVI_DELTA_MIN) & (zero("canopy_mean") >= CANOPY_MIN), "check_coverage": covered})


def land_candidates(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Cells that meet the one-row ``bounds`` and have land."""
    b = bounds.select(*[F.col(c).alias(f"__{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat")])
    meet = (F.col("min_lon") <= F.col("__max_lon")) & (F.col("max_lon") >= F.col("__min_lon")) & (F.col("min_lat") <= F.col("__max_lat")) & (F.col("max_lat") >= F.col("__min_lat"))
    return cells.where(F.col("land_frac") > 0).join(F.broadcast(b), meet, "left_semi")  # one row


def viable(df: DataFrame, gain: float = 0.01, ndvi: float = 0.0, canopy: float = 1.0) -> DataFrame:
    return df.where((F.col("gain_frac") >= gain) & (F.col("ndvi_delta") > ndvi) & (F.col("canopy_mean") >= canopy))


def known_groups(df: DataFrame, key: str) -> DataFrame:
    """Without the groups "Unknown" and "N/A"."""
    return df.where(~F.col(key).isin("Unknown", "N/A"))


def complete_bounds(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["min_lon", "min_lat", "max_lon", "max_lat"])


def cover_floor(df: DataFrame, cover: str, least_pct: float) -> DataFrame:
    """Pixels with at least ``least_pct`` per cent of cover."""
    return df.where(F.col(cover) >= least_pct)

"""Tile planning, tile statistics and the tile filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertable.functions.pixels import all_valid, encode_sentinel, ndvi
from rastertable.operators import filters, grid, zonal
from rastertable.operators.composite import wide_composite
from rastertable.sources.registry import apply_updates


def plan_tiles(aois: DataFrame, ordinal: str = "ordinal", size: float = grid.TILE_M, min_frac: float = grid.MIN_OVERLAP, all_owners: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tile records and tile-AOI links of AOIs with lon/lat bounds, id, biome_name, region and an explicit order.

    A tile goes to the first AOI that covers enough of it; with ``all_owners`` the links name all of them.
    """
    candidates = grid.tile_overlap(grid.projected_bounds(aois), size, min_frac)
    owned = grid.first_owner(candidates, ["id", "biome_name", "region"], ordinal)
    tiles = grid.tile_rows(owned, size)
    linked = candidates if all_owners else owned
    return tiles, linked.select(grid.tile_id(F.col("xi"), F.col("yi")).alias("tile_id"), F.col("id").alias("aoi_id")).distinct()


def yearly_ndvi(obs: DataFrame, before: int, after: int, year: str = "y") -> DataFrame:
    """ndvi_before, ndvi_after and their difference for each pixel, from medians; one aggregation over both years."""
    out = wide_composite(obs, {before: "before", after: "after"}, {"ndvi_": (F.col("NDVI"), "median")}, year)
    return out.withColumn("ndvi_delta", F.col("ndvi_after") - F.col("ndvi_before"))


def tile_stats(gain: DataFrame, delta: DataFrame, canopy: DataFrame, available: DataFrame, years: Sequence[int], tile: int = grid.TILE_PIXELS, method: str = "mean") -> DataFrame:
    """gain_frac, ndvi_delta, canopy_mean and s2_<year> of each tile.

    ``gain``: gx, gy, gain (0/1) over the whole pixel domain; NDVI difference and canopy count over gain pixels only. ``method`` is the
    reducer of the NDVI difference, mean or median. The layers meet on (gx, gy), then one aggregation makes the tiles.
    """
    wide = available.where(F.col("y").isin(*years)).groupBy("gx", "gy").agg(*[F.max(F.when(F.col("y") == y, F.col("available"))).alias(f"s2_{y}") for y in years])
    pixels = zonal.align(gain, delta.select("gx", "gy", "ndvi_delta"), canopy.select("gx", "gy", F.col("canopy").alias("canopy_mean")), wide)
    on_gain = lambda c: F.when(F.col("gain") == 1, F.col(c))
    reducer = F.avg if method == "mean" else F.median
    out = zonal.with_tile(pixels, tile).groupBy("xi", "yi").agg(
        F.avg(F.coalesce("gain", F.lit(0))).alias("gain_frac"), reducer(on_gain("ndvi_delta")).alias("ndvi_delta"), F.avg(on_gain("canopy_mean")).alias("canopy_mean"),
        *[F.avg(F.coalesce(f"s2_{y}", F.lit(0))).alias(f"s2_{y}") for y in years],
    )
    return encode_sentinel(out, ["ndvi_delta", "canopy_mean"], ["gain_frac", *[f"s2_{y}" for y in years]])


def filter_tiles(tiles: DataFrame, stats: DataFrame, available: Sequence[str], **limits: float) -> DataFrame:
    """All tiles, the pending ones with the status and reason that their statistics give; a pending tile without statistics fails."""
    decided = filters.tile_decision(stats, available, **limits)
    pending = tiles.where(F.col("status") == "pending").select("tile_id", "xi", "yi").join(decided, ["xi", "yi"], "left")
    updates = pending.select("tile_id", F.coalesce("status", F.lit("failed")).alias("status"), F.col("reason").alias("rejection_reason"), F.when(F.col("status").isNull(), "no statistics").alias("error"))
    return apply_updates(tiles, updates, ["status", "rejection_reason", "error"])


def tile_decision_summary(obs: DataFrame, before: int, after: int, tile: int, gain_min: float, ndvi_min: float, available_min: float) -> DataFrame:
    """Which tiles are valid and why the others are not, from an observation table alone: rows by status and reason code.

    A pixel gains if its mean cover (``cov``) rises above half from before to after. Observations with a shadow class do not count.
    """
    rows = obs.where(F.col("scl") != 3)
    bands = {"NDVI": (ndvi(F.col("b8"), F.col("b4")), "median"), "cover": (F.col("cov"), "mean"), "available": (all_valid(F.col("b8"), F.col("b4")), "max")}
    pixels = wide_composite(rows, {before: "_a", after: "_b"}, bands)
    gain = F.coalesce((F.col("cover_a") <= 50) & (F.col("cover_b") > 50), F.lit(False))
    stats = zonal.with_tile(pixels, tile).groupBy("xi", "yi").agg(
        F.avg(gain.cast("int")).alias("gain_frac"), F.avg(F.when(gain, F.col("NDVI_b") - F.col("NDVI_a"))).alias("ndvi_delta"), F.avg(F.when(gain, F.col("cover_b"))).alias("canopy_mean"),
        F.avg(F.coalesce("available_a", F.lit(0))).alias("s2_before"), F.avg(F.coalesce("available_b", F.lit(0))).alias("s2_after"),
    )
    decided = filters.tile_decision(stats, ["s2_before", "s2_after"], gain_min=gain_min, ndvi_min=ndvi_min, available_min=available_min)
    return decided.groupBy("status", "reason_code").agg(F.count("*").alias("n"))

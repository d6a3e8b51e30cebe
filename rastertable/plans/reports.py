"""Audit, AOI report, reconciliation and tile inspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertable.functions.scalars import UNKNOWN
from rastertable.operators import aggregates, sets, zonal


def aoi_audit(aois: DataFrame, tiles: DataFrame, links: DataFrame) -> DataFrame:
    """Every AOI with its tile counts by status, also those without tiles; one grouped join."""
    counts = aggregates.status_map(tiles.select("tile_id", "status").join(links, "tile_id"))
    out = aois.select(F.col("id").alias("aoi_id"), F.coalesce("biome_name", F.lit(UNKNOWN)).alias("biome"), F.coalesce("region", F.lit(UNKNOWN)).alias("region")).join(counts, "aoi_id", "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({"tile_counts": F.coalesce("tile_counts", F.create_map().cast("map<string,bigint>")), "total_tiles": F.coalesce("total_tiles", zero), "complete_tiles": F.coalesce("complete_tiles", zero), "has_coverage": F.coalesce("has_coverage", F.lit(False))})


def audit_summary(audit: DataFrame) -> DataFrame:
    return aggregates.coverage_by(audit, "biome")


def aoi_report(screened: DataFrame) -> dict[str, DataFrame]:
    """The tables of the AOI report: overview, reasons, extents, shares by region and biome, statistics and gain of each set."""
    side = screened.withColumn("set", F.when(F.col("valid"), "valid").otherwise("rejected"))
    return {
        "overview": side.groupBy("set").agg(F.count("*").alias("n")),
        "reasons": aggregates.rejection_counts(side, rejected=~F.col("valid")),
        "extents": aggregates.extent(side, "centroid_lon", "centroid_lat", "set"),
        "by_region": aggregates.shares(side, "set", "region"),
        "by_biome": aggregates.shares(side, "set", "biome_name"),
        "area_stats": aggregates.summary_stats(side.where("valid"), "area_km2"),
        "gain": aggregates.gain_totals(side.withColumn("gain_area", F.coalesce("area_km2", F.lit(0.0)) * F.coalesce("forest_gain_frac", F.lit(0.0))), "gain_area", "set"),
    }


#: The columns that name the rows of each table of the report.
_ITEMS = {"overview": ["set"], "reasons": ["rejection_reason"], "extents": ["set"], "by_region": ["set", "region"], "by_biome": ["set", "biome_name"], "area_stats": [], "gain": ["set"]}


def report_rows(report: dict[str, DataFrame]) -> DataFrame:
    """The tables of ``aoi_report`` as one: (section, item, measure, value)."""
    parts = []
    for section, table in report.items():
        names = _ITEMS[section]
        cells = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in table.columns if m not in names]
        parts.append(table.select(F.lit(section).alias("section"), F.concat_ws("/", *names).alias("item"), F.inline(F.array(*cells))))
    return sets.merge(*parts)


def reconcile(everything: DataFrame, valid: DataFrame, rejected: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts, missing ids, and ids done twice."""
    done = sets.merge(valid.select(key), rejected.select(key))
    return sets.reconcile(everything, valid, rejected, key), sets.missing_ids(everything, done, key), sets.duplicate_ids(done, key)


def inspect_tiles(pixels: DataFrame, land: DataFrame, zones: Sequence[str] = ("xi", "yi")) -> dict[str, DataFrame]:
    """For each tile gain, canopy, forest type mode and natural forest in one pass; tree probability and class shares by year over gain pixels.

    ``pixels``: zones, gx, gy, gain, canopy, forest_type, nat_forest; ``land``: gx, gy, y, trees, label.
    """
    metrics = pixels.groupBy(*zones).agg(F.avg("gain").alias("gain_mean"), F.avg("canopy").alias("canopy_mean"), F.mode("forest_type", deterministic=True).alias("forest_type"), F.avg("nat_forest").alias("nat_forest_mean"))
    on_gain = land.join(pixels.where(F.col("gain") == 1).select("gx", "gy", *zones), ["gx", "gy"])
    return {"metrics": metrics, "trees": zonal.time_series(on_gain, "trees", zones), "classes": zonal.class_share(on_gain, "label", [*zones, "y"])}

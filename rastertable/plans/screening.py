"""AOI screening: cells with layer fractions and ecoregions through the waterfall."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertable.functions.scalars import ecoregion_labels
from rastertable.operators import filters, polygons
from rastertable.operators.grid import bbox_metrics
from rastertable.operators.zonal import first_meeting, pick_least
from rastertable.sources.sinks import write_split
from rastertable.sources.workdir import work_dir

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
ECO_BOX = ("eco_x0", "eco_y0", "eco_x1", "eco_y1")


def smallest_ecoregion(cells: DataFrame, ecoregions: DataFrame, cell: float = 5.0) -> DataFrame:
    """Adds biome_name, biome_num and region of the smallest ecoregion that meets each cell; cells without one are Unknown.

    ``ecoregions`` has eco_id, biome_name, biome_num, realm, eco_area and its box as ``ECO_BOX``.
    """
    facts = ["biome_name", "biome_num", "realm"]
    chosen = first_meeting(cells, ecoregions, ["id"], BOX, ECO_BOX, facts, ["eco_area", "eco_id"], cell)
    out = cells.drop(*facts, "region").join(chosen, "id", "left")
    return out.select(*[c for c in out.columns if c not in facts], *ecoregion_labels(F.col("biome_name"), F.col("biome_num"), F.col("realm")))


def smallest_polygon(cells: DataFrame, points: DataFrame, regions: DataFrame, size: float = 1.0) -> DataFrame:
    """As ``smallest_ecoregion``, for ecoregions that are polygons on the globe, with holes, parts and pieces beyond the date line.

    ``points`` are their vertices (``polygons.vertices``), ``regions`` has eco_id, biome_name, biome_num, realm and eco_area. Of regions of
    the same edges only the smallest can be chosen, and cells of equal boxes have one choice.
    """
    facts = ["biome_name", "biome_num", "realm"]
    edges = polygons.cut_at_date_line(polygons.ring_edges(points))
    known = regions.select(F.col("eco_id").alias("poly"), *facts, "eco_area")
    same = polygons.shapes(edges.join(known.select("poly").distinct(), "poly", "left_semi"))
    first = same.join(known, "poly").groupBy("shape").agg(F.min_by(F.struct("poly", *facts, "eco_area"), F.struct("eco_area", "poly")).alias("__f")).select("shape", "__f.*")
    met = polygons.boxes_meeting_shapes(cells, BOX, edges, same, size)
    chosen = pick_least(met.join(first, "shape"), BOX, facts, ["eco_area", "poly"])
    out = cells.drop(*facts, "region").join(chosen, list(BOX), "left").select(*[c for c in cells.columns if c not in (*facts, "region")], *facts)
    return out.select(*[c for c in out.columns if c not in facts], *ecoregion_labels(F.col("biome_name"), F.col("biome_num"), F.col("realm")))


def cell_fractions(cells: DataFrame, layers: Mapping[str, DataFrame], step: float) -> DataFrame:
    """Adds the mean of each point layer (lon, lat and the value that names it) over each cell of a regular grid; 0 without points.

    Each layer is read once and combined before its shuffle; cells and means all hash on the cell. Layers given as one and the same table
    with a column for each are one scan and one shuffle.
    """
    out = cells.withColumns({"__i": F.floor((F.col("min_lon") + step / 2) / step), "__j": F.floor((F.col("min_lat") + step / 2) / step)})
    tables = {id(points): points for points in layers.values()}
    for key, points in tables.items():
        names = [name for name, of in layers.items() if id(of) == key]
        means = points.groupBy(F.floor(F.col("lon") / step).alias("__i"), F.floor(F.col("lat") / step).alias("__j")).agg(*[F.avg(name).alias(name) for name in names])
        out = out.drop(*names).join(means, ["__i", "__j"], "left").withColumns({name: F.coalesce(name, F.lit(0.0)) for name in names})
    return out.drop("__i", "__j")


def screen_cells(cells: DataFrame, layers: Mapping[str, DataFrame], ecoregions: DataFrame, step: float = 0.25, limits: tuple[float, float, float, float] = (filters.MIN_LAND, filters.MIN_VEG, filters.MIN_GAIN, filters.MIN_SCENES)) -> DataFrame:
    """Cells with area, centroid, ecoregion, the four fractions, rejection_reason and valid.

    ``layers``: point tables by land_frac, veg_fraction, forest_gain_frac and s2_frac. All are measured once and one CASE decides, so the
    plan has each table once; what a stage would never have measured is 0, as the cascade of single stages leaves it.
    """
    facts = smallest_ecoregion(bbox_metrics(cells), ecoregions)
    return screened(cell_fractions(facts, layers, step), limits)


def screen_aois(cells: DataFrame, layers: Mapping[str, DataFrame], ecoregions: DataFrame, step: float = 0.25, limits: tuple[float, float, float, float] = (filters.MIN_LAND, filters.MIN_VEG, filters.MIN_GAIN, filters.MIN_SCENES), path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected cells, written to ``path`` (a work folder by default) as two partitions of one table and read from there."""
    spark, out = cells.sparkSession, screen_cells(cells, layers, ecoregions, step, limits)
    path = path or work_dir(spark, "screened")
    write_split(out, path)
    both = spark.read.schema(out.schema).parquet(path)
    return both.where("valid"), both.where("NOT valid")


def screened(table: DataFrame, limits: tuple[float, float, float, float]) -> DataFrame:
    """The waterfall over cells whose fractions are known."""
    return filters.reject_defaults(filters.waterfall(table, filters.screening_stages(limits=limits)))

"""Grids and addressing: lon/lat cells, the equal-area tile grid, ownership of tiles and raster blocks.

Pixels are addressed by ``gx = floor(x / 10 m)``, ``gy = floor(y / 10 m)``; tiles of 128 pixels by ``xi = floor(gx / 128)``, ``yi = floor(gy / 128)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertable.functions import projection
from rastertable.functions.scalars import UNKNOWN

# Tile edge in pixels, pixel edge in metres, least share of a tile inside its AOI.
TILE_PIXELS = 128
PIXEL_M = 10.0
TILE_M = TILE_PIXELS * PIXEL_M
MIN_OVERLAP = 0.1
# Bounds of the lon/lat grid.
LON_BOUNDS, LAT_BOUNDS, STEP = (-180.0, 180.0), (-60.0, 85.0), 0.25


def lonlat_grid(spark: SparkSession, step: float = STEP, min_lon: float = LON_BOUNDS[0], min_lat: float = LAT_BOUNDS[0], max_lon: float = LON_BOUNDS[1], max_lat: float = LAT_BOUNDS[1]) -> DataFrame:
    """Cells of a lon/lat grid from snapped bounds: min_lon, min_lat, max_lon, max_lat, id.

    Edges are integers times the step, so they carry no running error; upper edges stop at the world's.
    """
    x0, x1 = math.floor(min_lon / step), math.ceil(max_lon / step)
    y0, y1 = math.floor(min_lat / step), math.ceil(max_lat / step)
    nx, ny = max(0, x1 - x0), max(0, y1 - y0)
    edge = lambda i: F.round(i * F.lit(step), 4)
    cells = spark.range(nx * ny).select((F.col("id") % max(nx, 1) + x0).alias("i"), (F.floor(F.col("id") / max(nx, 1)) + y0).alias("j"))
    lon, lat = edge(F.col("i")), edge(F.col("j"))
    return cells.select(
        lon.alias("min_lon"), lat.alias("min_lat"), F.least(edge(F.col("i") + 1), F.lit(180.0)).alias("max_lon"), F.least(edge(F.col("j") + 1), F.lit(85.0)).alias("max_lat"),
        F.concat(F.lit("aoi_"), lon.cast("string"), F.lit("_"), lat.cast("string")).alias("id"),
    )


def snap(c: Column, size: float, down: bool = True) -> Column:
    """The multiple of ``size`` at or below (or at or above)."""
    return (F.floor(c / size) if down else F.ceil(c / size)) * F.lit(size)


def projected_bounds(df: DataFrame) -> DataFrame:
    """Adds x_min_m, y_min_m, x_max_m, y_max_m of lon/lat bounds."""
    return df.withColumns({"x_min_m": projection.x_of(F.col("min_lon")), "x_max_m": projection.x_of(F.col("max_lon")), "y_min_m": projection.y_of(F.col("min_lat")), "y_max_m": projection.y_of(F.col("max_lat"))})


def tile_overlap(aois: DataFrame, size: float = TILE_M, min_frac: float = MIN_OVERLAP) -> DataFrame:
    """A row for each AOI and tile of which the AOI covers ``min_frac`` or more; ``aois`` has bounds in metres.

    Adds xi, yi and overlap (area). Overlap is a product of two lengths, each of which depends on one axis alone, so a column of
    tiles that fails by itself is dropped before rows are made.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.ceil(F.col(hi) / size) - 1)
    length = lambda i, lo, hi: F.greatest(F.lit(0.0), F.least((F.col(i) + 1) * size, F.col(hi)) - F.greatest(F.col(i) * F.lit(size), F.col(lo)))
    real = aois.where((F.col("x_max_m") > F.col("x_min_m")) & (F.col("y_max_m") > F.col("y_min_m")))
    columns = real.withColumn("xi", F.explode(span("x_min_m", "x_max_m"))).withColumn("__dx", length("xi", "x_min_m", "x_max_m")).where(F.col("__dx") >= min_frac * size)
    cells = columns.withColumn("yi", F.explode(span("y_min_m", "y_max_m"))).withColumn("overlap", F.col("__dx") * length("yi", "y_min_m", "y_max_m"))
    return cells.where(F.col("overlap") >= min_frac * size * size).drop("__dx")


def first_owner(candidates: DataFrame, keep: list[str], ordinal: str = "ordinal") -> DataFrame:
    """One row for each tile: the columns ``keep`` of the candidate with the least ordinal."""
    chosen = candidates.groupBy("xi", "yi").agg(F.min_by(F.struct(*keep), F.col(ordinal)).alias("__own"))
    return chosen.select("xi", "yi", *[F.col(f"__own.{c}").alias(c) for c in keep])


def tile_id(xi: Column, yi: Column) -> Column:
    return F.concat(F.lit("tile_"), xi.cast("string"), F.lit("_"), yi.cast("string"))


def tile_rows(owned: DataFrame, size: float = TILE_M) -> DataFrame:
    """Tile records from owned tiles (xi, yi, id, biome_name, region): metre and degree bounds, owner, status pending."""
    x0, y0 = F.col("xi") * F.lit(size), F.col("yi") * F.lit(size)
    x1, y1 = (F.col("xi") + 1) * F.lit(size), (F.col("yi") + 1) * F.lit(size)
    empty = {"task_id": "string", "submitted_at": "timestamp", "completed_at": "timestamp", "rejection_reason": "string", "error": "string"}
    return owned.select(
        tile_id(F.col("xi"), F.col("yi")).alias("tile_id"), F.col("xi").cast("long"), F.col("yi").cast("long"),
        x0.alias("x_min_m"), y0.alias("y_min_m"), x1.alias("x_max_m"), y1.alias("y_max_m"),
        projection.lon_of(x0).alias("min_lon"), projection.lat_of(y0).alias("min_lat"), projection.lon_of(x1).alias("max_lon"), projection.lat_of(y1).alias("max_lat"),
        F.coalesce("biome_name", F.lit(UNKNOWN)).alias("biome"), F.coalesce("region", F.lit(UNKNOWN)).alias("region"), F.array("id").alias("aoi_ids"), F.lit("pending").alias("status"),
        *[F.lit(None).cast(t).alias(c) for c, t in empty.items()],
    )


def geotransform(x_min: Column, y_max: Column, scale: float = PIXEL_M) -> Column:
    return F.array(F.lit(scale), F.lit(0.0), x_min, F.lit(0.0), F.lit(-scale), y_max)


def tile_extent(tiles: DataFrame, size: float = TILE_M, key: str = "aoi_id") -> DataFrame:
    """For each AOI the range of its tiles, the north-west origin, and the numbers of columns and rows."""
    out = tiles.groupBy(key).agg(
        F.min("xi").alias("xi_min"), F.max("xi").alias("xi_max"), F.min("yi").alias("yi_min"), F.max("yi").alias("yi_max"),
        F.min_by("x_min_m", "xi").alias("origin_x"), (F.max_by("y_min_m", "yi") + size).alias("origin_y"),
    )
    return out.withColumns({"n_cols": F.col("xi_max") - F.col("xi_min") + 1, "n_rows": F.col("yi_max") - F.col("yi_min") + 1})


def extent_bbox(extent: DataFrame, size: float = TILE_M) -> DataFrame:
    """The rectangle of an extent in metres."""
    return extent.withColumns({"bx_min": F.col("origin_x"), "bx_max": F.col("origin_x") + F.col("n_cols") * size, "by_max": F.col("origin_y"), "by_min": F.col("origin_y") - F.col("n_rows") * size})


def local_rowcol(tiles: DataFrame, extent: DataFrame, key: str = "aoi_id") -> DataFrame:
    """Row (from the north) and column of each tile in its AOI's extent."""
    joined = tiles.join(extent.select(key, "xi_min", "yi_min", "n_rows"), key)
    return joined.withColumns({"row": F.col("n_rows") - 1 - (F.col("yi") - F.col("yi_min")), "col": F.col("xi") - F.col("xi_min")})


def bbox_metrics(df: DataFrame) -> DataFrame:
    """Adds area_km2 (exact in the equal-area projection) and the centroid of lon/lat bounds."""
    dx = projection.x_of(F.col("max_lon")) - projection.x_of(F.col("min_lon"))
    dy = projection.y_of(F.col("max_lat")) - projection.y_of(F.col("min_lat"))
    return df.withColumns({"area_km2": dx * dy / 1e6, "centroid_lon": (F.col("min_lon") + F.col("max_lon")) / 2, "centroid_lat": (F.col("min_lat") + F.col("max_lat")) / 2})


def extent_union(a: DataFrame, b: DataFrame, pad: float = 0.5, upper_pad: float | None = None) -> DataFrame:
    """One row: the padded bounds of two layers, inside the world. ``upper_pad`` is the pad of the upper bounds where it differs."""
    upper = pad if upper_pad is None else upper_pad
    both = a.select("min_lon", "min_lat", "max_lon", "max_lat").unionByName(b.select("min_lon", "min_lat", "max_lon", "max_lat"))
    out = both.agg(F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"))
    return out.select(
        F.greatest(F.col("min_lon") - pad, F.lit(-180.0)).alias("min_lon"), F.greatest(F.col("min_lat") - pad, F.lit(-90.0)).alias("min_lat"),
        F.least(F.col("max_lon") + upper, F.lit(180.0)).alias("max_lon"), F.least(F.col("max_lat") + upper, F.lit(90.0)).alias("max_lat"),
    )


def degree_tile_grid(boxes: DataFrame, tile_km: float, km_per_degree: float = 111.32) -> DataFrame:
    """Lon/lat tiles of about ``tile_km`` in each box: the longitude step widens with the cosine of the middle latitude.

    ``boxes`` has an id and lon/lat bounds. Origins snap down to multiples of the steps; only whole tiles are made.
    """
    lat_step = F.lit(tile_km / km_per_degree)
    lon_step = lat_step / F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2))
    steps = boxes.withColumns({"lat_step": lat_step, "lon_step": lon_step})
    snapped = steps.withColumns({"x0": F.floor(F.col("min_lon") / F.col("lon_step")) * F.col("lon_step"), "y0": F.floor(F.col("min_lat") / F.col("lat_step")) * F.col("lat_step")})
    sized = snapped.withColumns({"nx": F.floor((F.col("max_lon") - F.col("x0")) / F.col("lon_step")), "ny": F.floor((F.col("max_lat") - F.col("y0")) / F.col("lat_step"))}).where("nx > 0 and ny > 0")
    cells = sized.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
    lon, lat = F.col("x0") + F.col("i") * F.col("lon_step"), F.col("y0") + F.col("j") * F.col("lat_step")
    return cells.select("id", "i", "j", lon.alias("min_lon"), lat.alias("min_lat"), (lon + F.col("lon_step")).alias("max_lon"), (lat + F.col("lat_step")).alias("max_lat"))


def cell_bin(df: DataFrame, lon: str, lat: str, res: float, lon0: float, lat0: float, n_lon: int | None = None, n_lat: int | None = None) -> DataFrame:
    """Adds bx, by: the bin of a point; points without a place, and those outside the grid if its size is given, go."""
    out = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumns({"bx": F.floor((F.col(lon) - lon0) / res), "by": F.floor((F.col(lat) - lat0) / res)})
    if n_lon is not None:
        out = out.where((F.col("bx") >= 0) & (F.col("bx") < n_lon))
    return out if n_lat is None else out.where((F.col("by") >= 0) & (F.col("by") < n_lat))


def cell_cover(df: DataFrame, res: float, lon0: float, lat0: float, n_lon: int, n_lat: int) -> DataFrame:
    """A row for each bin that a box touches; bounds may come in either order and are clamped to the grid."""
    def ends(a: str, b: str, origin: float, n: int) -> Column:
        lo, hi = F.floor((F.least(a, b) - origin) / res), F.floor((F.greatest(a, b) - origin) / res)
        keep = lambda c: F.least(F.greatest(c, F.lit(0).cast("long")), F.lit(n - 1).cast("long"))
        return F.sequence(keep(lo), keep(hi))

    return df.dropna(subset=["min_lon", "min_lat", "max_lon", "max_lat"]).withColumn("bx", F.explode(ends("min_lon", "max_lon", lon0, n_lon))).withColumn("by", F.explode(ends("min_lat", "max_lat", lat0, n_lat)))


def block_partition(pixels: DataFrame, n: int, width: int, height: int, px: str = "px", py: str = "py") -> DataFrame:
    """Adds block_x, block_y of an n by n split of a raster; the last blocks take what is left over."""
    w, h = max(1, width // n), max(1, height // n)
    return pixels.withColumns({"block_x": F.least(F.floor(F.col(px) / w), F.lit(n - 1).cast("long")), "block_y": F.least(F.floor(F.col(py) / h), F.lit(n - 1).cast("long"))})


def crop_to_data(bins: DataFrame, around: DataFrame, margin: int = 2) -> DataFrame:
    """Bins within ``margin`` of the used range of ``around`` (both have bx, by); the range is one row."""
    used = around.agg(F.min("bx").alias("__x0"), F.max("bx").alias("__x1"), F.min("by").alias("__y0"), F.max("by").alias("__y1"))
    near = F.col("bx").between(F.col("__x0") - margin, F.col("__x1") + margin) & F.col("by").between(F.col("__y0") - margin, F.col("__y1") + margin)
    return bins.join(F.broadcast(used), near).drop("__x0", "__x1", "__y0", "__y1")

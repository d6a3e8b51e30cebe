"""Readers of AOI files, checkpoints and registry tables, and the catalog of derived layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertable.functions.pixels import class_in, decode_cover, unmask
from rastertable.sources.json_arrays import PIECE, json_records

# A record's fields in the files, and our names for them.
_FIELDS = {
    "id": ("id", "string"), "minLon": ("min_lon", "double"), "minLat": ("min_lat", "double"), "maxLon": ("max_lon", "double"), "maxLat": ("max_lat", "double"),
    "aoi_area_km2": ("area_km2", "double"), "centroid_lon": ("centroid_lon", "double"), "centroid_lat": ("centroid_lat", "double"), "biome_name": ("biome_name", "string"), "biome_num": ("biome_num", "int"),
    "region": ("region", "string"), "land_frac": ("land_frac", "double"), "veg_fraction": ("veg_fraction", "double"), "forest_gain_frac": ("forest_gain_frac", "double"), "has_s2": ("has_s2", "double"), "rejection_reason": ("rejection_reason", "string"),
}
_RECORD = ", ".join(f"{k} {t}" for k, (_, t) in _FIELDS.items())
_EITHER = f"properties struct<{', '.join(f'{k}: {t}' for k, (_, t) in _FIELDS.items())}>, {_RECORD}"


def _unwrapped(df: DataFrame, prefix: str = "") -> list[Column]:
    return [F.coalesce(F.col(f"{prefix}properties.{k}"), F.col(f"{prefix}{k}")).alias(name) for k, (name, _) in _FIELDS.items()]


def read_aois(spark: SparkSession, path: str) -> DataFrame:
    """AOI records of a JSON array, bare or wrapped in "properties"; fields that are absent are null."""
    raw = spark.read.schema(_EITHER).option("multiLine", True).json(path)
    return raw.select(*_unwrapped(raw))


def load_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Screened AOIs of a checkpoint: {"valid": [...], "rejected": [...]}, or a bare list, whose records count as valid."""
    record = "struct<properties: struct<" + ", ".join(f"{k}: {t}" for k, (_, t) in _FIELDS.items()) + ">, " + ", ".join(f"{k}: {t}" for k, (_, t) in _FIELDS.items()) + ">"
    raw = spark.read.schema(f"valid array<{record}>, rejected array<{record}>, {_EITHER}").option("multiLine", True).json(path)
    parts = []
    for side in ("valid", "rejected"):
        one = raw.select(F.explode(side).alias("r"))
        parts.append(one.select(*_unwrapped(one, "r."), F.lit(side == "valid").alias("valid")))
    bare = raw.where(F.col("valid").isNull() & F.col("rejected").isNull())
    return parts[0].union(parts[1]).union(bare.select(*_unwrapped(bare), F.lit(True).alias("valid")))


def scan_aois(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """As ``read_aois``, with each file read by as many tasks as it has pieces."""
    raw = json_records(spark, path, piece).select(F.from_json("value", _EITHER).alias("r"))
    return raw.select(*_unwrapped(raw, "r."))


def scan_checkpoint(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """As ``load_checkpoint``, with each file read by as many tasks as it has pieces. Arrays of other names are left out."""
    raw = json_records(spark, path, piece).where("array IS NULL OR array IN ('valid', 'rejected')")
    parsed = raw.select(F.from_json("value", _EITHER).alias("r"), F.coalesce(F.col("array") == "valid", F.lit(True)).alias("valid"))
    return parsed.select(*_unwrapped(parsed, "r."), "valid")


def with_aoi_ids(tiles: DataFrame, links: DataFrame) -> DataFrame:
    """Tiles with the array of their AOIs, by one join; a tile has few AOIs."""
    ids = links.groupBy("tile_id").agg(F.sort_array(F.collect_list("aoi_id")).alias("aoi_ids"))
    return tiles.join(ids, "tile_id", "left").withColumn("aoi_ids", F.coalesce("aoi_ids", F.array().cast("array<string>")))


def read_registry(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """The registry's tiles with aoi_ids; the status filter reaches the scan."""
    tiles = spark.read.parquet(f"{path}/tiles")
    if status is not None:
        tiles = tiles.where(F.col("status") == status)
    return with_aoi_ids(tiles, spark.read.parquet(f"{path}/tile_aois"))


def sample_grid(tiles: DataFrame, bands: list[str]) -> DataFrame:
    """An aggregated raster back as rows of values: for each yi one array for each band, by xi. A row is one grid line."""
    lines = tiles.groupBy("yi").agg(F.sort_array(F.collect_list(F.struct("xi", *bands))).alias("__r"))
    return lines.select("yi", *[F.col(f"__r.{b}").alias(b) for b in bands])


def dataset_catalog() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Derived layers by name: each a function from a source layer (gx, gy, and the band named in its docstring) to (gx, gy, value)."""

    def layer(make: Callable[[], Column], doc: str) -> Callable[[DataFrame], DataFrame]:
        def run(source: DataFrame) -> DataFrame:
            return source.select("gx", "gy", make().alias("value"))

        run.__doc__ = doc
        return run

    cover = lambda: layer(lambda: decode_cover(F.col("cover")), "band cover, a byte")
    return {
        "trees": layer(lambda: unmask(class_in(F.col("land_cover"), 10)), "band land_cover: class 10"),
        "crop": layer(lambda: unmask(class_in(F.col("land_cover"), 40)), "band land_cover: class 40"),
        "tree_crop": layer(lambda: unmask(class_in(F.col("tree_crop"), 2)), "band tree_crop: class 2"),
        "natural_forest": layer(lambda: unmask(F.col("natural") / 250.0), "band natural, 0 to 250"),
        "canopy_height": layer(lambda: unmask(F.col("height")), "band height in metres"),
        "cover_2017": cover(),
        "cover_2020": cover(),
    }


def register_layers(sources: dict[str, DataFrame], prefix: str = "layer_") -> None:
    """Temporary views of the named layers; ``prefix`` keeps them apart from the session's other views."""
    makers = dataset_catalog()
    for name, df in sources.items():
        makers[name](df).createOrReplaceTempView(f"{prefix}{name}")

"""Registered queries of the raster engine and the SQL that states each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rastertable.plans import catalog_layers, catalog_pixels, catalog_places, catalog_reports, catalog_tiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = catalog_pixels.QUERIES | catalog_tiles.QUERIES | catalog_reports.QUERIES | catalog_layers.QUERIES | catalog_places.QUERIES
ORACLE_SQL: dict[str, str] = catalog_pixels.SQL | catalog_tiles.SQL | catalog_reports.SQL | catalog_layers.SQL | catalog_places.SQL

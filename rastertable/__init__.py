"""Raster and tile analytics on Spark tables."""

"""Fixed schemas of the engine's tables."""

from __future__ import annotations

_BOUNDS = "min_lon double, min_lat double, max_lon double, max_lat double"
AOI = f"id string, {_BOUNDS}, area_km2 double, centroid_lon double, centroid_lat double, biome_name string, biome_num int, region string, land_frac double, veg_fraction double, forest_gain_frac double, has_s2 double, rejection_reason string, valid boolean"
TILE = f"tile_id string, xi long, yi long, x_min_m double, y_min_m double, x_max_m double, y_max_m double, {_BOUNDS}, biome string, region string, status string, task_id string, submitted_at timestamp, completed_at timestamp, rejection_reason string, error string, created_at timestamp, updated_at timestamp"
LINK = "tile_id string, aoi_id string"
SCENE = f"scene_id string, sensor string, ts timestamp, cloudy_pct double, mode string, polarisations array<string>, {_BOUNDS}"
STATUS = ("pending", "valid", "submitted", "complete", "rejected", "failed")
TERMINAL = ("complete", "rejected")

"""The tile registry as tables: inserts of new tiles, updates, resets and status rules.

A registry is a pair of frames (tiles, links). Operators return new frames; writing them is the caller's step, as a whole
table or as an append where the docstring says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertable.schemas import STATUS
from rastertable.sources.readers import with_aoi_ids

# Allowed changes of status.
TRANSITIONS = {"pending": ("valid", "rejected", "failed"), "valid": ("submitted", "failed"), "submitted": ("complete", "failed"), "failed": ("pending",), "rejected": ("pending",), "complete": ("pending",)}
HISTORY = ("task_id", "submitted_at", "completed_at", "rejection_reason", "error")


def insert_new(tiles: DataFrame, incoming: DataFrame, order: Sequence[str] = (), now: Column | None = None, key: str = "tile_id") -> DataFrame:
    """The rows of ``incoming`` to append: the first of each key that ``tiles`` lacks, with both timestamps set."""
    w = Window.partitionBy(key).orderBy(*(order or [key]))
    fresh = incoming.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").join(tiles.select(key), key, "left_anti")
    stamp = F.current_timestamp() if now is None else now
    return fresh.withColumns({"created_at": stamp, "updated_at": stamp})


def insert_links(links: DataFrame, incoming: DataFrame) -> DataFrame:
    """The links to append, also for tiles that were there before."""
    return incoming.select("tile_id", "aoi_id").distinct().join(links, ["tile_id", "aoi_id"], "left_anti")


def apply_updates(tiles: DataFrame, updates: DataFrame, fields: Sequence[str], now: Column | None = None, key: str = "tile_id") -> DataFrame:
    """All tiles with the given fields set where ``updates`` (one row a key) has a value, or names the field in its array ``set``."""
    named = "set" in updates.columns
    up = updates.select(F.col(key), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in fields], *([F.col("set").alias("__set")] if named else []))
    out = tiles.join(up, key, "left")
    new = {}
    for c in fields:
        value = F.coalesce(F.col(f"__{c}"), F.col(c))
        new[c] = F.when(F.array_contains("__set", c), F.col(f"__{c}")).otherwise(value) if named else value
    stamp = F.current_timestamp() if now is None else now
    return out.withColumns(new | {"updated_at": F.when(F.col("__hit"), stamp).otherwise(F.col("updated_at"))}).select(*tiles.columns)


def reset(tiles: DataFrame, status: str | None = None, clear_history: bool = False, now: Column | None = None) -> DataFrame:
    """All tiles; those of a status (or all that are not pending) are pending again, without history if asked for."""
    hit = affected(status)
    new = {"status": F.when(hit, "pending").otherwise(F.col("status")), "updated_at": F.when(hit, F.current_timestamp() if now is None else now).otherwise(F.col("updated_at"))}
    if clear_history:
        new |= {c: F.when(~hit, F.col(c)) for c in HISTORY if c in tiles.columns}
    return tiles.withColumns(new)


def affected(status: str | None = None) -> Column:
    """Which tiles a reset changes."""
    return F.col("status") == status if status is not None else F.col("status") != "pending"


def clear(tiles: DataFrame) -> DataFrame:
    """An empty table of the same schema."""
    return tiles.limit(0)


def get_tile(tiles: DataFrame, links: DataFrame, tile_id: str) -> DataFrame:
    return with_aoi_ids(tiles.where(F.col("tile_id") == tile_id), links.where(F.col("tile_id") == tile_id))


def plan_once(tiles: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan if the registry is empty, else nothing to add."""
    return plan if tiles.isEmpty() else plan.limit(0)


def pending_tiles(tiles: DataFrame, links: DataFrame, status: str = "pending") -> DataFrame:
    """A row for each tile of the status and each of its AOIs, the form in which groups of any size are safe."""
    return tiles.where(F.col("status") == status).join(links, "tile_id")


def pending_groups(tiles: DataFrame, links: DataFrame, status: str = "pending") -> DataFrame:
    """The same as one array of tile ids for each AOI; an AOI has a bounded number of tiles."""
    return pending_tiles(tiles, links, status).groupBy("aoi_id").agg(F.sort_array(F.collect_list("tile_id")).alias("tile_ids"))


def illegal_transitions(changes: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Changes of status that are not allowed; a status that stays is allowed."""
    allowed = F.lit(False)
    for s, nexts in TRANSITIONS.items():
        allowed = allowed | ((F.col(before) == s) & F.col(after).isin(*nexts))
    return changes.where(~(allowed | (F.col(before) == F.col(after))))


def registry_summary(tiles: DataFrame, top: int = 10) -> DataFrame:
    """(section, item, n): tiles by status with zeros, and the first ``top`` reasons of rejection, complete biomes and complete regions."""
    states = tiles.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUS])
    by_status = states.select(F.inline(F.array(*[F.struct(F.lit("status").alias("section"), F.lit(s).alias("item"), F.col(s).alias("n")) for s in STATUS])))
    out = by_status
    for section, key, status in (("reason", "rejection_reason", "rejected"), ("biome", "biome", "complete"), ("region", "region", "complete")):
        rows = tiles.where((F.col("status") == status) & F.col(key).isNotNull()).groupBy(F.col(key).alias("item")).agg(F.count("*").alias("n"))
        out = out.union(rows.orderBy(F.desc("n"), "item").limit(top).select(F.lit(section), "item", "n"))
    return out

"""Zonal statistics and spatial joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertable.functions.pixels import REDUCERS
from rastertable.operators.grid import TILE_PIXELS


def with_tile(pixels: DataFrame, tile: int = TILE_PIXELS) -> DataFrame:
    """Adds xi, yi."""
    return pixels.withColumns({"xi": F.floor(F.col("gx") / tile), "yi": F.floor(F.col("gy") / tile)})


def zonal(layer: DataFrame, zones: Sequence[str], bands: Mapping[str, str], default: float | None = None) -> DataFrame:
    """One row for each zone: a named reducer for each band. Masked pixels do not count; a zone without any gets ``default``."""
    out = layer.groupBy(*zones).agg(*[REDUCERS[r](F.col(b)).alias(f"{b}_{r}") for b, r in bands.items()])
    return out if default is None else out.fillna(default, [f"{b}_{r}" for b, r in bands.items()])


def tile_aggregate(pixels: DataFrame, bands: Sequence[str], tile: int = TILE_PIXELS) -> DataFrame:
    """Mean of each band over a tile's unmasked pixels."""
    return with_tile(pixels, tile).groupBy("xi", "yi").agg(*[F.avg(b).alias(b) for b in bands])


def pack_tile(pixels: DataFrame, bands: Sequence[str], tile: int = TILE_PIXELS) -> DataFrame:
    """One row for each tile with an array for each band, row by row from the north; a tile has at most ``tile`` squared pixels."""
    place = (tile - 1 - F.pmod("gy", F.lit(tile))) * tile + F.pmod("gx", F.lit(tile))
    packed = with_tile(pixels, tile).groupBy("xi", "yi").agg(F.sort_array(F.collect_list(F.struct(place.alias("at"), *bands))).alias("__p"))
    return packed.select("xi", "yi", *[F.col(f"__p.{b}").alias(b) for b in bands])


def tile_all_valid(pixels: DataFrame, valid: str, tile: int = TILE_PIXELS) -> DataFrame:
    """Tiles whose every pixel is valid."""
    return with_tile(pixels, tile).groupBy("xi", "yi").agg(F.min(valid).alias("least"), F.count("*").alias("n_pixels")).where("least = 1").select("xi", "yi", "n_pixels")


def time_series(obs: DataFrame, band: str, zones: Sequence[str], year: str = "y") -> DataFrame:
    return obs.groupBy(*zones, year).agg(F.avg(band).alias(band))


def class_share(obs: DataFrame, band: str, group: Sequence[str] = ("y",)) -> DataFrame:
    """Count and per cent of each class in its group."""
    counts = obs.where(F.col(band).isNotNull()).groupBy(*group, band).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy(*group)), F.lit(1)))


def class_histogram(obs: DataFrame, band: str, group: Sequence[str] = ("y",)) -> DataFrame:
    """The same as one map from class to count for each group; the classes of a layer are few."""
    counts = obs.where(F.col(band).isNotNull()).groupBy(*group, F.col(band).cast("string").alias("__c")).agg(F.count("*").alias("__n"))
    return counts.groupBy(*group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__c", "__n")))).alias("histogram"))


def _cells(df: DataFrame, box: Sequence[str], size: float) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    return df.withColumn("__cx", F.explode(span(box[0], box[2]))).withColumn("__cy", F.explode(span(box[1], box[3])))


#: Rows of a stretch of the input in which rows of equal boxes are bunched, as a power of two; no array is longer.
STRETCH_BITS = 17


def bunched(df: DataFrame, box: Sequence[str]) -> DataFrame:
    """Rows of equal boxes as one row: the box and the other columns in the array __rows; ``unbunched`` tells them apart again.

    A box is then dealt out and compared once for all its rows. Only rows of one stretch of the input are put together, so an array is bounded.
    """
    rest = [c for c in df.columns if c not in box] or [F.lit(1).alias("__one")]
    stretch = df.withColumn("__stretch", F.shiftright(F.monotonically_increasing_id(), STRETCH_BITS))
    return stretch.groupBy(*box, "__stretch").agg(F.collect_list(F.struct(*rest)).alias("__rows")).drop("__stretch")


def unbunched(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each entry of __rows; gives ``columns``."""
    return df.select("*", F.inline("__rows")).select(*columns)


def bbox_join(left: DataFrame, right: DataFrame, left_box: Sequence[str], right_box: Sequence[str], cell: float, how: str = "inner") -> DataFrame:
    """Pairs whose boxes meet (edges touch). Boxes are (x_min, y_min, x_max, y_max) column names, without a name on both sides.

    Both sides are dealt to cells of ``cell`` units and joined on them. A pair is given once, in the cell that holds the
    lower left corner of the boxes' intersection, so no pass removes doubles. With ``how`` left, unmatched rows stay. Equal boxes of the
    right side are compared as one.
    """
    lx0, ly0, lx1, ly1 = map(F.col, left_box)
    rx0, ry0, rx1, ry1 = map(F.col, right_box)
    meet = (lx0 <= rx1) & (lx1 >= rx0) & (ly0 <= ry1) & (ly1 >= ry0)
    a, b = left.withColumn("__id", F.monotonically_increasing_id()) if how == "left" else left, right
    dealt = _cells(a, left_box, cell).join(_cells(bunched(b, right_box), right_box, cell), ["__cx", "__cy"]).where(meet)
    first = dealt.where((F.col("__cx") == F.floor(F.greatest(lx0, rx0) / cell)) & (F.col("__cy") == F.floor(F.greatest(ly0, ry0) / cell)))
    once = unbunched(first, [*a.columns, *right.columns])
    if how == "inner":
        return once
    found = once.select("__id", *right.columns)
    return a.join(found, "__id", "left").drop("__id")


def first_meeting(left: DataFrame, right: DataFrame, key: Sequence[str], left_box: Sequence[str], right_box: Sequence[str], take: Sequence[str], order: Sequence[str], cell: float) -> DataFrame:
    """For each ``key`` of ``left`` the columns ``take`` of the right row that comes first in ``order`` of those whose boxes meet its box.

    The pairs are never made. Of equal right boxes only the first can be chosen; and where a right box reaches beyond a cell on all sides, it
    meets every left box that is dealt there, so rows that come after it are dropped in that cell. A few are left, however many there are. The
    first of all is kept in every cell that it shares with a left box, for what drops it there would be chosen in its place.
    """
    rank = F.struct(*order)
    few = right.groupBy(*right_box).agg(F.min_by(F.struct(*take), rank).alias("__take"), F.min(rank).alias("__order"))
    dealt, at = _cells(few, right_box, cell), lambda c: F.floor(F.col(c) / cell)
    beyond = (at(right_box[0]) < F.col("__cx")) & (at(right_box[2]) > F.col("__cx")) & (at(right_box[1]) < F.col("__cy")) & (at(right_box[3]) > F.col("__cy"))
    first = dealt.where(beyond).groupBy("__cx", "__cy").agg(F.min("__order").alias("__first"))
    near = dealt.join(first, ["__cx", "__cy"], "left").where("__first IS NULL OR __order <= __first").drop("__first")
    lx0, ly0, lx1, ly1, rx0, ry0, rx1, ry1 = map(F.col, (*left_box, *right_box))
    meet = (lx0 <= rx1) & (lx1 >= rx0) & (ly0 <= ry1) & (ly1 >= ry0)
    pairs = _cells(left.select(*key, *left_box), left_box, cell).join(near, ["__cx", "__cy"]).where(meet)
    chosen = pairs.groupBy(*key).agg(F.min_by("__take", "__order").alias("__take"))
    return chosen.select(*key, *[F.col(f"__take.{c}").alias(c) for c in take])


def box_level(box: Sequence[str], least: float) -> Column:
    """The level whose cells are as wide as the box or just wider; cells of level 0 are ``least`` wide, those of each next one twice as wide."""
    return F.ceil(F.log2(F.greatest(F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1]), F.lit(least)) / least)).cast("int")


def level_cells(df: DataFrame, box: Sequence[str], least: float, levels: Column) -> DataFrame:
    """Each row for every cell (__level, __cx, __cy) of the given levels that its box meets; column __own goes."""
    out = df.withColumn("__level", F.explode(levels)).withColumn("__s", F.pow(F.lit(2.0), F.col("__level")) * least)
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.col("__s")), F.floor(F.col(hi) / F.col("__s")))
    return out.withColumn("__cx", F.explode(span(box[0], box[2]))).withColumn("__cy", F.explode(span(box[1], box[3]))).drop("__own", "__s")


def bbox_join_levels(left: DataFrame, right: DataFrame, left_box: Sequence[str], right_box: Sequence[str], least: float, split: int = 1 << 16) -> DataFrame:
    """As ``bbox_join`` (inner), for boxes of very different sizes.

    Cells come in levels, each twice as wide as the one before, the first ``least`` units. A box lives at the level whose cells are as wide as
    the box or just wider, in four cells at most, and looks up the cells of wider levels that the other side uses, again four at most for each
    level. So a box has rows in proportion to the number of levels, whatever its size; a pair is given once, as in ``bbox_join``. In a cell
    both sides are split into parts of ``split``, and each part of the one meets each part of the other. Equal boxes of the right side are
    compared as one.
    """
    a, b = left.withColumn("__own", box_level(left_box, least)), bunched(right, right_box).withColumn("__own", box_level(right_box, least))
    used = [sorted(r[0] for r in x.select("__own").distinct().collect()) for x in (a, b)]  # a level is a power of two, so they are few
    lx0, ly0, lx1, ly1 = map(F.col, left_box)
    rx0, ry0, rx1, ry1 = map(F.col, right_box)
    meet = (lx0 <= rx1) & (lx1 >= rx0) & (ly0 <= ry1) & (ly1 >= ry0)
    size = F.pow(F.lit(2.0), F.col("__level")) * least
    cell = ["__level", "__cx", "__cy"]

    def joined(ours: DataFrame, theirs: DataFrame) -> DataFrame:
        count = lambda df, name: df.groupBy(*cell).agg(F.ceil(F.count("*") / split).cast("int").alias(name)).where(f"{name} > 1")
        n, m = count(ours, "__n"), count(theirs, "__m")  # one row for ``split`` rows at most, so they may be broadcast

        def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
            parts = df.join(F.broadcast(n), cell, "left").join(F.broadcast(m), cell, "left")
            at = F.floor(F.rand(1) * F.coalesce(mine, F.lit(1))).cast("int")
            return parts.withColumn(f"{mine}_at", at).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("__n", "__m")

        both = dealt(ours, "__n", "__m").join(dealt(theirs, "__m", "__n"), [*cell, "__n_at", "__m_at"]).where(meet)
        return both.where((F.col("__cx") == F.floor(F.greatest(lx0, rx0) / size)) & (F.col("__cy") == F.floor(F.greatest(ly0, ry0) / size)))

    home = F.array("__own")
    above = lambda levels, own: F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("__own") if own else x > F.col("__own"))
    columns = [*left.columns, *right.columns]
    if not all(used):
        return unbunched(joined(level_cells(a, left_box, least, home), level_cells(b, right_box, least, home)), columns)
    upward = joined(level_cells(a, left_box, least, above(used[1], True)), level_cells(b, right_box, least, home))
    downward = joined(level_cells(a, left_box, least, home), level_cells(b, right_box, least, above(used[0], False)))
    return unbunched(upward, columns).union(unbunched(downward, columns))


def point_join(points: DataFrame, boxes: DataFrame, x: str, y: str, box: Sequence[str], cell: float, upper_open: bool = False) -> DataFrame:
    """Pairs of a point and a box that holds it; a point falls in one cell, so only boxes are dealt out, and equal ones as one."""
    x0, y0, x1, y1 = map(F.col, box)
    inside = (F.col(x) >= x0) & (F.col(y) >= y0) & ((F.col(x) < x1) & (F.col(y) < y1) if upper_open else (F.col(x) <= x1) & (F.col(y) <= y1))
    placed = points.withColumns({"__cx": F.floor(F.col(x) / cell), "__cy": F.floor(F.col(y) / cell)})
    met = placed.join(_cells(bunched(boxes, box), box, cell), ["__cx", "__cy"]).where(inside)
    return unbunched(met, [*points.columns, *boxes.columns])


def rasterize(pixels: DataFrame, boxes: DataFrame, box: Sequence[str], cell: float, out: str) -> DataFrame:
    """The pixels (gx, gy) with ``out``: 1 where the pixel's centre is in a box, else 0. Only the painted pixels are shuffled again."""
    centres = pixels.select("gx", "gy", (F.col("gx") + 0.5).alias("__x"), (F.col("gy") + 0.5).alias("__y"))
    painted = point_join(centres, boxes, "__x", "__y", box, cell, upper_open=True).select("gx", "gy").distinct().withColumn(out, F.lit(1))
    return pixels.drop(out).join(painted, ["gx", "gy"], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def pick_least(pairs: DataFrame, key: Sequence[str], take: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """For each key the columns ``take`` of the pair that comes first in ``order``."""
    chosen = pairs.groupBy(*key).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("__t"))
    return chosen.select(*key, *[F.col(f"__t.{c}").alias(c) for c in take])


def point_in_tile(points: DataFrame, tiles: DataFrame, gx: str = "gx", gy: str = "gy", tile: int = TILE_PIXELS) -> DataFrame:
    """Joins points on the pixel grid with the tile that holds them; an equi-join."""
    placed = points.withColumns({"xi": F.floor(F.col(gx) / tile), "yi": F.floor(F.col(gy) / tile)})
    return placed.join(tiles, ["xi", "yi"])


def save_first(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Joins each left row with the first right row of its key; left rows without one go."""
    w = Window.partitionBy(*on).orderBy(*order)
    return left.join(right.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"), list(on))


def align(first: DataFrame, *others: DataFrame, how: str = "left") -> DataFrame:
    """Joins layers on the pixel address; all sides hash on (gx, gy), so a chain of layers shuffles each once."""
    out = first
    for other in others:
        out = out.join(other, ["gx", "gy"], how)
    return out

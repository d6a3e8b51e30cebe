"""Tables clustered along a space-filling curve, so that a box reads few row groups.

The Morton key of a cell interleaves the bits of its column and row; cells that are close get keys that are close. A table is written in
ranges of the key, each file sorted by it, so the least and greatest key of a row group span a compact area. A box is broken
into a few ranges of keys; they and the exact test reach the scan, which skips the row groups that no range meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a column or row number; cells are numbered from 0 to 2^31 - 1.
BITS = 31
#: Ranges of keys that a box is broken into, at most; with fewer the ranges also cover cells beside the box, which the exact test drops.
RANGES = 32
KEY = "zkey"


def _spread(c: Column) -> Column:
    """The bits of a number below 2^31 moved to the even places."""
    out = c.cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(mask)
    return out


def morton(x: Column, y: Column) -> Column:
    """The key of cell (x, y), both from 0 to 2^31 - 1."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def key_ranges(x0: int, y0: int, x1: int, y1: int, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` closed ranges of keys that hold every cell of the closed box.

    Squares of the quadtree that the box cuts are opened, the largest first, as long as the number of ranges allows.
    """
    if x0 > x1 or y0 > y1:
        return []
    spread = lambda v: sum(((v >> b) & 1) << 2 * b for b in range(BITS))
    whole: list[tuple[int, int, int]] = []
    cut = [(0, 0, BITS)]
    while cut and len(whole) + len(cut) + 3 <= 2 * most:
        x, y, level = cut.pop(0)
        if level == 0 or (x0 <= x and x + (1 << level) - 1 <= x1 and y0 <= y and y + (1 << level) - 1 <= y1):
            whole.append((x, y, level))
            continue
        half = 1 << level - 1
        for cx, cy in ((x, y), (x + half, y), (x, y + half), (x + half, y + half)):
            if cx <= x1 and cx + half > x0 and cy <= y1 and cy + half > y0:
                cut.append((cx, cy, level - 1))
    starts = sorted((spread(x) | spread(y) << 1, level) for x, y, level in whole + cut)
    out: list[list[int]] = []
    for low, level in starts:
        high = low + (1 << 2 * level) - 1
        if out and low <= out[-1][1] + 1:
            out[-1][1] = high
        else:
            out.append([low, high])
    while len(out) > most:  # closes the smallest gap
        k = min(range(1, len(out)), key=lambda k: out[k][0] - out[k - 1][1])
        out[k - 1][1] = out.pop(k)[1]
    return [(a, b) for a, b in out]


def write_clustered(df: DataFrame, path: str, x: str = "gx", y: str = "gy", origin: tuple[int, int] = (0, 0), size: int = 1, files: int | None = None, group_bytes: int = 8 << 20) -> None:
    """Writes ``df`` by ranges of the key of cells of ``size`` units, counted from ``origin``, which lies below all places.

    ``files`` are the range partitions (default: the session's shuffle partitions), ``group_bytes`` the size of a row group.
    """
    cell = lambda c, o: F.floor((F.col(c) - o) / size)
    keyed = df.withColumn(KEY, morton(cell(x, origin[0]), cell(y, origin[1])))
    ranged = keyed.repartitionByRange(files, KEY) if files else keyed.repartitionByRange(KEY)
    ranged.sortWithinPartitions(KEY).write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], x: str = "gx", y: str = "gy", origin: tuple[int, int] = (0, 0), size: int = 1) -> DataFrame:
    """The rows of a clustered table whose place lies in the closed box (x_min, y_min, x_max, y_max)."""
    cells = [max(0, int((v - o) // size)) for v, o in zip(box, origin * 2, strict=True)]
    inside = F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3])
    ranges = key_ranges(*cells) if box[2] >= origin[0] and box[3] >= origin[1] else []
    near = F.lit(False)
    for low, high in ranges:
        near = near | F.col(KEY).between(low, high)
    return spark.read.parquet(path).where(near & inside)


def read_footprints(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: tuple[str, str, str, str], reach: tuple[float, float], x: str, y: str, origin: tuple[int, int] = (0, 0), size: int = 1) -> DataFrame:
    """The rows of a table clustered by the corner (x, y) of their footprint that meet the box; no footprint is larger than ``reach``."""
    x0, y0, x1, y1 = map(F.col, columns)
    wide = read_box(spark, path, (box[0] - reach[0], box[1] - reach[1], box[2], box[3]), x, y, origin, size)
    return wide.where((x0 <= box[2]) & (x1 >= box[0]) & (y0 <= box[3]) & (y1 >= box[1]))

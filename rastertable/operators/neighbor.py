"""Neighbourhood operators on a pixel table: morphology, local deviation and slope.

Pixels are dealt once to square blocks of ``BLOCK`` pixels a side with a border of the operator's reach, so each operator is one
shuffle and a task holds one block. Within a block the neighbourhood is worked out on arrays, where an absent or masked pixel
is NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pixels of a block's side; a block and its border are what a task holds.
BLOCK = 256
Grids = Mapping[str, np.ndarray]


def in_blocks(df: DataFrame, bands: list[str], reach: int, outputs: list[str], compute: Callable[[Grids, np.ndarray], Grids]) -> DataFrame:
    """``df`` with the columns ``outputs`` (double), which ``compute`` works out from the grids of ``bands`` and of the pixels that are there.

    A pixel's outputs may depend on pixels up to ``reach`` away. All columns of ``df`` pass by; ``outputs`` replace columns of that name.
    """
    block, names = BLOCK, df.drop(*outputs).columns
    spans = lambda c: F.sequence(F.floor((F.col(c) - reach) / block), F.floor((F.col(c) + reach) / block))
    kept = df.drop(*outputs)
    dealt = kept.withColumn("__bx", F.explode(spans("gx"))).withColumn("__by", F.explode(spans("gy")))
    numeric = dealt.withColumns({f"__{b}": F.col(b).cast("double") for b in bands} | {"__gx": F.col("gx").cast("long"), "__gy": F.col("gy").cast("long")})
    schema = T.StructType(list(kept.schema.fields) + [T.StructField(o, T.DoubleType()) for o in outputs])

    def run(rows: pa.Table) -> pa.Table:
        side = block + 2 * reach
        x, y = (rows.column(f"__{g}").to_numpy() - rows.column(f"__b{a}").to_numpy() * block + reach for g, a in (("gx", "x"), ("gy", "y")))
        there = np.zeros((side, side), bool)
        there[x, y] = True
        grids = {}
        for b in bands:
            grids[b] = np.full((side, side), np.nan)
            grids[b][x, y] = rows.column(f"__{b}").to_numpy()
        with np.errstate(all="ignore"):
            found = compute(grids, there)
        core = np.flatnonzero((x >= reach) & (x < reach + block) & (y >= reach) & (y < reach + block))
        own = rows.take(pa.array(core)).select(names)
        for o in outputs:
            values = found[o][x[core], y[core]]
            own = own.append_column(o, pa.array(values, pa.float64(), mask=np.isnan(values)))
        return own

    return numeric.groupBy("__bx", "__by").applyInArrow(run, schema)


def _shifted(grid: np.ndarray, dx: int, dy: int, fill: float = np.nan) -> np.ndarray:
    """The grid's value ``dx`` and ``dy`` further on; ``fill`` beyond its edge."""
    out = np.full_like(grid, fill)
    n, m = grid.shape
    out[max(0, -dx) : n - max(0, dx), max(0, -dy) : m - max(0, dy)] = grid[max(0, dx) : n - max(0, -dx), max(0, dy) : m - max(0, -dy)]
    return out


State = tuple[np.ndarray, ...]


def sliding(state: State, join: Callable[[State, State], State], nothing: tuple[float, ...], radius: int) -> State:
    """What ``join`` makes of the places up to ``radius`` before and after each place of the first axis.

    The axis is cut into stretches as long as the window. A window is the end of one stretch and the begin of the next, and both are
    running results within the stretch, so each place is joined three times, whatever the radius. ``nothing`` is joined without effect.
    """
    width, n = 2 * radius + 1, len(state[0])
    room = -(-(n + 2 * radius) // width) * width
    padded = [np.full((room, *x.shape[1:]), e, x.dtype) for x, e in zip(state, nothing, strict=True)]
    for p, x in zip(padded, state, strict=True):
        p[radius : radius + n] = x
    cut = tuple(p.reshape(-1, width, *p.shape[1:]) for p in padded)
    head, tail = (tuple(c.copy() for c in cut) for _ in range(2))
    at = lambda s, k: tuple(c[:, k] for c in s)
    for k in range(1, width):
        for h, v in zip(head, join(at(head, k - 1), at(cut, k)), strict=True):
            h[:, k] = v
        for t, v in zip(tail, join(at(cut, width - 1 - k), at(tail, width - k)), strict=True):
            t[:, width - 1 - k] = v
    head, tail = (tuple(c.reshape(room, *c.shape[2:]) for c in s) for s in (head, tail))
    begins = np.arange(n) % width == 0  # the window is one stretch
    later = tuple(h[2 * radius : 2 * radius + n].copy() for h in head)
    for x, e in zip(later, nothing, strict=True):
        x[begins] = e
    return join(tuple(t[:n] for t in tail), later)


def _around(state: State, join: Callable[[State, State], State], nothing: tuple[float, ...], radius: int, axis: int) -> State:
    turned = tuple(np.swapaxes(x, 0, axis) for x in state)
    return tuple(np.swapaxes(x, 0, axis) for x in sliding(turned, join, nothing, radius))


def _largest(grid: np.ndarray, shape: str, radius: int) -> np.ndarray:
    """The largest value around each place, NaN apart."""
    along = lambda g, axis: _around((g,), lambda a, b: (np.fmax(a[0], b[0]),), (np.nan,), radius, axis)[0]
    rows = along(grid, 0)
    return along(rows, 1) if shape == "square" else np.fmax(rows, along(grid, 1))


def _joined_moments(a: State, b: State) -> State:
    """Numbers, means and sums of squared differences from the mean of two disjoint sets of values together; loses no digits."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    apart = b[1] - a[1]
    return n, a[1] + apart * share, a[2] + b[2] + apart**2 * a[0] * share


def _as_before(df: DataFrame, band: str, found: DataFrame, out: str) -> DataFrame:
    return found.withColumn(out, F.col(out).cast(df.schema[band].dataType))


def dilate(df: DataFrame, mask: str, out: str, shape: str = "plus", radius: int = 1) -> DataFrame:
    """Largest value in the neighbourhood, over pixels that are there: a plus (disc of radius 1) or a square."""
    return _as_before(df, mask, in_blocks(df, [mask], radius, [out], lambda g, there: {out: _largest(g[mask], shape, radius)}), out)


def erode(df: DataFrame, mask: str, out: str, shape: str = "plus", radius: int = 1) -> DataFrame:
    """Smallest value in the neighbourhood."""
    return _as_before(df, mask, in_blocks(df, [mask], radius, [out], lambda g, there: {out: -_largest(-g[mask], shape, radius)}), out)


def close(df: DataFrame, mask: str, out: str, mode: str = "zero") -> DataFrame:
    """Dilates, then erodes.

    ``zero``: masked pixels count as 0, a true closing. ``skip``: masked and 0 pixels take no part in the second step, which
    then changes nothing but what the first step left masked.
    """

    def compute(g: Grids, there: np.ndarray) -> Grids:
        zero = np.where(there, np.nan_to_num(g[mask]), np.nan)
        grown = np.where(there, _largest(zero, "plus", 1), np.nan)
        if mode == "skip":
            return {out: np.nan_to_num(-_largest(-np.where(grown == 0, np.nan, grown), "plus", 1))}
        return {out: -_largest(-grown, "plus", 1)}

    return _as_before(df, mask, in_blocks(df, [mask], 2, [out], compute), out)


def grow_domain(df: DataFrame, keys: tuple[str, str] = ("gx", "gy")) -> DataFrame:
    """The pixels of a sparse mask and their four neighbours."""
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    near = df.select(*keys, F.inline(steps))
    return near.select((F.col(keys[0]) + F.col("dx")).alias(keys[0]), (F.col(keys[1]) + F.col("dy")).alias(keys[1])).distinct()


def window_moments(grid: np.ndarray, radius: int) -> State:
    """Number, mean and sum of squared differences of the values (NaN apart) in the square window around each place.

    Values are first taken less the grid's mean, so that what is common to all of them costs no digits; the mean is less by that, too.
    """
    valid = ~np.isnan(grid)
    centre = grid[valid].mean() if valid.any() else 0.0
    state: State = (valid.astype(float), np.where(valid, grid - centre, 0.0), np.zeros_like(grid))
    for axis in (0, 1):
        state = _around(state, _joined_moments, (0.0, 0.0, 0.0), radius, axis)
    return state


def neighborhood_std(df: DataFrame, band: str, out: str, radius: int = 3) -> DataFrame:
    """Population deviation in a square window, from numbers, means and squares joined stretch by stretch, so that large values lose no digits."""

    def compute(g: Grids, there: np.ndarray) -> Grids:
        n, _, squares = window_moments(g[band], radius)
        return {out: np.where(n > 0, np.sqrt(squares / np.maximum(n, 1)), np.nan)}

    return in_blocks(df, [band], radius, [out], compute)


def slope_deg(df: DataFrame, z: str, out: str, spacing: float = 10.0) -> DataFrame:
    """Terrain slope in degrees from the four neighbours; null where one is missing."""

    def compute(g: Grids, there: np.ndarray) -> Grids:
        dx, dy = ((_shifted(g[z], a, b) - _shifted(g[z], -a, -b)) / (2 * spacing) for a, b in ((1, 0), (0, 1)))
        return {out: np.degrees(np.arctan(np.sqrt(dx**2 + dy**2)))}

    return in_blocks(df, [z], 1, [out], compute)

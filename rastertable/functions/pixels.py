"""Pixel algebra. A masked pixel is NULL; every function takes and returns columns, so Catalyst fuses them into one projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bands of an optical scene, and scene classes that hold no usable surface.
OPTICAL_BANDS = ("B2", "B3", "B4", "B5", "B6", "B7", "B8")
INVALID_SCL = (0, 3, 8, 9, 10)
# Fixed value: what stands for "no gain pixels" at the output edge.
NO_GAIN = -9999.0


def self_mask(c: Column) -> Column:
    """0 becomes masked."""
    return F.nullif(c, F.lit(0))


def update_mask(c: Column, mask: Column) -> Column:
    """Keeps ``c`` where the mask is neither 0 nor masked."""
    return F.when(mask.cast("double") != 0, c)


def unmask(c: Column, value: float = 0) -> Column:
    return F.coalesce(c, F.lit(value))


def class_in(c: Column, *codes: int) -> Column:
    """1 where the class code is one of ``codes``, else 0; masked stays masked."""
    return c.isin(*codes).cast("int")


def remap_ranges(c: Column, ranges: Sequence[tuple[int, int]], default: int = 0) -> Column:
    """1 in any of the closed ranges, else ``default``; masked stays masked."""
    hit = reduce(lambda a, b: a | b, [c.between(lo, hi) for lo, hi in ranges])
    return F.when(c.isNotNull(), F.when(hit, 1).otherwise(default))


def remap(df: DataFrame, column: str, table: DataFrame, default: int | None = None) -> DataFrame:
    """Replaces codes through a (code, value) table; the table is small by nature and Spark broadcasts it by its size."""
    out = df.join(table.select(F.col("code").alias("__code"), F.col("value").alias("__value")), F.col(column) == F.col("__code"), "left")
    value = F.col("__value") if default is None else F.coalesce("__value", F.lit(default))
    return out.withColumn(column, F.when(F.col(column).isNotNull(), value)).drop("__code", "__value")


def both(a: Column, b: Column, result: Column) -> Column:
    """``result`` only where neither input is masked (SQL would let ``false AND NULL`` through)."""
    return F.when(a.isNotNull() & b.isNotNull(), result)


def and_(a: Column, b: Column) -> Column:
    return both(a, b, ((a != 0) & (b != 0)).cast("int"))


def or_(a: Column, b: Column) -> Column:
    return both(a, b, ((a != 0) | (b != 0)).cast("int"))


def not_(a: Column) -> Column:
    return (a == 0).cast("int")


def above(c: Column, threshold: float) -> Column:
    """1 where strictly above."""
    return (c > threshold).cast("int")


def decode_cover(c: Column) -> Column:
    """A byte 0 to 255 as per cent."""
    return c / 2.55


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); masked where an input is negative or the sum is 0."""
    return F.when((a >= 0) & (b >= 0), F.try_divide(a - b, a + b))


def ndvi(nir: Column, red: Column) -> Column:
    return normalised_difference(nir, red)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return F.try_divide(2.5 * (nir - red), nir + 6.0 * red - 7.5 * blue + 1.0)


def formula(text: str, **bands: Column) -> Column:
    """A formula of named bands with + - * / and parentheses, such as ``2.5 * (n - r) / (n + 6 * r + 1)``.

    Dividing by zero gives a masked pixel, as everywhere here.
    """
    import ast

    operations = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide}

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in operations:
            return operations[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            return bands[node.id]
        raise ValueError(f"not a band formula: {text}")

    return build(ast.parse(text, mode="eval").body)


def add_indices(df: DataFrame, keep: Sequence[str] = (), bands: Sequence[str] = OPTICAL_BANDS) -> DataFrame:
    """The optical bands with NDVI and EVI, and the columns named in ``keep``."""
    return df.select(*keep, *bands, ndvi(F.col("B8"), F.col("B4")).alias("NDVI"), evi(F.col("B8"), F.col("B4"), F.col("B2")).alias("EVI"))


def scl_valid(scl: Column, invalid: Sequence[int] = INVALID_SCL) -> Column:
    return ~scl.isin(*invalid)


def scl_mask(df: DataFrame, bands: Sequence[str], scl: str = "SCL") -> DataFrame:
    """Masks the bands of pixels with an invalid scene class."""
    return df.withColumns({b: F.when(scl_valid(F.col(scl)), F.col(b)) for b in bands})


def cloud_mask(df: DataFrame, bands: Sequence[str], probability: str = "cloud_prob", scl: str = "SCL", most: float = 40) -> DataFrame:
    """Masks pixels whose cloud probability is above ``most``, or whose class is shadow (3) or cirrus (10)."""
    bad = (F.col(probability) > most) | F.col(scl).isin(3, 10)
    return df.withColumns({b: F.when(~bad, F.col(b)) for b in bands})


def band_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clamp(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounds a value; masked stays masked (greatest and least alone would skip it)."""
    out = c if lo is None else F.greatest(c, F.lit(float(lo)))
    out = out if hi is None else F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def geo_mean(*cols: Column) -> Column:
    return F.pow(reduce(lambda a, b: a * b, cols), F.lit(1.0 / len(cols)))


def all_valid(*bands: Column) -> Column:
    """1 if every band is present, else 0."""
    return reduce(lambda a, b: a & b, [b.isNotNull() for b in bands]).cast("int")


def argmax_band(*cols: Column) -> Column:
    """Number of the largest band from 0, the first if equal; masked if any band is."""
    values = F.array(*cols)
    return F.when(all_valid(*cols) == 1, F.array_position(values, F.array_max(values)) - 1)


def confidence(*cols: Column, floor: float = 1e-6) -> Column:
    """The largest band over the sum of all, the sum at least ``floor``."""
    total = reduce(lambda a, b: a + b, cols)
    return F.greatest(*cols) / F.greatest(total, F.lit(floor))


def clip(df: DataFrame, gx_min: int, gy_min: int, gx_max: int, gy_max: int) -> DataFrame:
    """Pixels of a half-open box."""
    return df.where((F.col("gx") >= gx_min) & (F.col("gx") < gx_max) & (F.col("gy") >= gy_min) & (F.col("gy") < gy_max))


def encode_sentinel(df: DataFrame, gain_bands: Sequence[str], other_bands: Sequence[str]) -> DataFrame:
    """Bands over gain pixels get the sentinel where a tile has none; the others get 0."""
    return df.withColumns({b: unmask(F.col(b), NO_GAIN) for b in gain_bands} | {b: unmask(F.col(b), 0.0) for b in other_bands})


def prefixed(df: DataFrame, prefix: str, bands: Sequence[str], keys: Sequence[str] = ("gx", "gy")) -> DataFrame:
    """The keys, and the bands with a name prefix."""
    return df.select(*keys, *[F.col(b).alias(f"{prefix}{b}") for b in bands])


#: Reducers by name, each a function from a column to an aggregate.
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
    "mode": lambda c: F.mode(c, deterministic=True),
    "stddev": F.stddev_pop,
    "p25": lambda c: F.percentile(c, 0.25),
    "to_list": F.collect_list,
}

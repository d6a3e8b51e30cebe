"""Scalar rules: names, codes, reasons and guarded arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
# Replacements that shorten biome names, in this order.
BIOME_SHORT = [
    ("Tropical & Subtropical ", "T&S "),
    ("Temperate ", "Temp. "),
    (", Savannas & Shrublands", "/Sav"),
    ("Grasslands", "Grass"),
    ("Forests/Taiga", "Forests"),
    (" & Mixed Forests", ""),
    ("Woodlands & Scrub", "Scrub"),
    ("Deserts & Xeric Shrublands", "Deserts/Xeric"),
    ("Flooded Grasslands & Savannas", "Flooded Grass"),
    ("Montane Grasslands & Shrublands", "Montane Grass"),
    (" Forests", ""),
]
# Reasons by bit, and codes by reason.
REASON_BITS = [(1, "insufficient_veg"), (2, "missing_s2"), (4, "no_land"), (8, "no_forest_gain")]
REASON_CODES = {"no_land": 1, "insufficient_veg": 2, "no_forest_gain": 3, "missing_s2": 4, "valid": 5}
# Class names.
LAND_COVER_NAMES = ["Water", "Trees", "Grass", "Flooded veg", "Crops", "Shrub", "Built", "Bare", "Snow/ice"]
FOREST_TYPE_NAMES = {1: "Naturally regenerating", 10: "Primary forest", 20: "Planted/Plantation"}
LABEL_NAMES = ["agrocrop", "nat_regen", "plantation", "restoration"]
# Lower edges of canopy height classes in metres.
CANOPY_EDGES = [0, 2, 5, 10, 15, 20, 25, 30]


def safe_num(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c, F.lit(default))


def clean_text(c: Column) -> Column:
    """Null, "N/A" and "" are "Unknown"."""
    return F.when(c.isNull() | c.isin("N/A", ""), UNKNOWN).otherwise(c)


def ecoregion_labels(biome_name: Column, biome_num: Column, realm: Column) -> list[Column]:
    """biome_name, biome_num and region of a cell: biome 11 is rock and ice everywhere, a null number is -1."""
    number = F.coalesce(biome_num, F.lit(-1))
    rock = number == 11
    return [F.when(rock, "Rock and Ice").otherwise(clean_text(biome_name)).alias("biome_name"), number.alias("biome_num"), F.when(rock, "Global").otherwise(clean_text(realm)).alias("region")]


def reason_from_bits(code: Column) -> Column:
    text = F.concat_ws(" + ", *[F.when(code.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in REASON_BITS])
    return F.when(code == 0, "valid").when(text == "", "unknown").otherwise(text)


def reason_code(reason: Column) -> Column:
    """1 to 5, or 0 for an unknown reason."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REASON_CODES.items() for x in kv]), reason), F.lit(0))


def short_biome(c: Column) -> Column:
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), BIOME_SHORT, c)


def pct(part: Column, total: Column) -> Column:
    """Per cent, 0 for an empty total."""
    return F.coalesce(F.try_divide(100.0 * part, total), F.lit(0.0))


def gain_area(area: Column, fraction: Column) -> Column:
    return F.coalesce(area, F.lit(0.0)) * F.coalesce(fraction, F.lit(0.0))


def gamma(c: Column, power: float) -> Column:
    return F.pow(c, F.lit(power))


def canopy_class(height: Column) -> Column:
    """"0-2", "2-5" ... "30+" by height in metres."""
    out = F.when(height < 0, None)
    for lo, hi in zip(CANOPY_EDGES, CANOPY_EDGES[1:], strict=False):
        out = out.when(height < hi, f"{lo}-{hi}")
    return out.when(height.isNotNull(), f"{CANOPY_EDGES[-1]}+")


def land_cover_name(code: Column) -> Column:
    return F.when((code >= 0) & (code < len(LAND_COVER_NAMES)), F.element_at(F.array(*map(F.lit, LAND_COVER_NAMES)), (code + 1).cast("int")))


def forest_type_name(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FOREST_TYPE_NAMES.items() for x in kv]), code.cast("int"))


def contains_ignoring_case(c: Column, text: str) -> Column:
    return F.contains(F.lower(c), F.lit(text.lower()))


def transient_error(message: Column) -> Column:
    """Whether an error text names a limit that passes."""
    return F.coalesce(F.lower(message).rlike("429|concurrent|quota|memory"), F.lit(False))


def midpoint(lo: Column, hi: Column) -> Column:
    return (lo + hi) / 2


def map_total(m: Column) -> Column:
    """Sum of a map's counts; 0 for an empty or null map."""
    return F.aggregate(F.coalesce(F.map_values(m), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def map_get(m: Column, key: str, default: int = 0) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def iso_utc(ts: Column) -> Column:
    """An instant as ISO text of UTC to the second, 2024-03-10T07:30:00Z, whatever the session's time zone and its summer time."""
    wall = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_seconds(ts).cast("decimal(18,6)"))
    return F.concat(F.replace(wall.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))

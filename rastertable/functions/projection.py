"""EPSG:4326 to and from EPSG:6933, the ellipsoidal cylindrical equal-area projection, as column expressions.

Formulas: J. P. Snyder, Map Projections: A Working Manual (1987), section 10, on the WGS 84 ellipsoid with a standard
parallel of 30 degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Semi-major axis and flattening of WGS 84, standard parallel.
AXIS = 6378137.0
FLATTENING = 1 / 298.257223563
PARALLEL = math.radians(30.0)

E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
K0 = math.cos(PARALLEL) / math.sqrt(1 - E2 * math.sin(PARALLEL) ** 2)


def _q(sine: float) -> float:
    return (1 - E2) * (sine / (1 - E2 * sine * sine) - math.log((1 - E * sine) / (1 + E * sine)) / (2 * E))


Q_POLE = _q(1.0)


def x_of(lon: Column) -> Column:
    return F.radians(lon) * (AXIS * K0)


def y_of(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E * s) / (1 + E * s)) / (2 * E))
    return q * (AXIS / (2 * K0))


def lon_of(x: Column) -> Column:
    return F.degrees(x / (AXIS * K0))


def lat_of(y: Column) -> Column:
    """By the series of the authalic latitude in e^2, e^4, e^6; beyond the pole the pole is returned."""
    ratio = F.greatest(F.least(y * (2 * K0 / (AXIS * Q_POLE)), F.lit(1.0)), F.lit(-1.0))
    beta = F.asin(ratio)
    e4, e6 = E2**2, E2**3
    return F.degrees(beta + (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + (761 * e6 / 45360) * F.sin(6 * beta))

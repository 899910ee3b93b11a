"""UTM on WGS84 as Column expressions: Krueger's series to the fourth order in the third flattening, under a millimetre within a zone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of WGS84 and UTM.
A, FLAT, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
N = FLAT / (2 - FLAT)
E = 2 * math.sqrt(N) / (1 + N)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
#: Krueger's coefficients forward, backward, and from the conformal latitude.
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def utm_forward(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(easting, northing) of degrees."""
    away, phi = F.radians(lon - (zone * 6 - 183)), F.radians(lat)
    t = F.sinh(F.atanh(F.sin(phi)) - E * F.atanh(E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east = eta + sum(c * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, c in enumerate(ALPHA, 1))
    north = xi + sum(c * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, c in enumerate(ALPHA, 1))
    return EAST + SCALE * RADIUS * east, F.when(south, SOUTH).otherwise(0.0) + SCALE * RADIUS * north


def utm_inverse(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    xi, eta = (north - F.when(south, SOUTH).otherwise(0.0)) / (SCALE * RADIUS), (east - EAST) / (SCALE * RADIUS)
    x = xi - sum(c * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, c in enumerate(BETA, 1))
    y = eta - sum(c * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, c in enumerate(BETA, 1))
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi + sum(c * F.sin(2 * k * chi) for k, c in enumerate(DELTA, 1))
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)

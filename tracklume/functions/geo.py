"""Geodesy, sensor geometry and box overlap as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)


def lla_to_ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(WGS84_E2) * F.sin(phi) * F.sin(phi))
    return (n + alt) * F.cos(phi) * F.cos(lam), (n + alt) * F.cos(phi) * F.sin(lam), (n * (1 - WGS84_E2) + alt) * F.sin(phi)


def lla_to_enu(lat: Column, lon: Column, alt: Column, origin: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """East, north, up in metres about an origin (degrees, degrees, metres)."""
    at = [F.lit(float(v)) for v in origin]
    p, o = lla_to_ecef(lat, lon, alt), lla_to_ecef(*at)
    d = [a - b for a, b in zip(p, o)]
    sp, cp, sl, cl = F.sin(F.radians(at[0])), F.cos(F.radians(at[0])), F.sin(F.radians(at[1])), F.cos(F.radians(at[1]))
    east = -sl * d[0] + cl * d[1]
    north = -sp * cl * d[0] - sp * sl * d[1] + cp * d[2]
    up = cp * cl * d[0] + cp * sl * d[1] + sp * d[2]
    return east, north, up


def polar_to_cartesian(rng: Column, azimuth: Column, elevation: Column, convention: str = "north-clockwise") -> tuple[Column, Column, Column]:
    """x, y, z from range and angles in radians; the convention says where azimuth zero is and which way it turns."""
    flat = rng * F.cos(elevation)
    across, along = flat * F.sin(azimuth), flat * F.cos(azimuth)
    xy = {"north-clockwise": (across, along), "east-counterclockwise": (along, across), "north-counterclockwise": (-across, along), "east-clockwise": (along, -across)}
    if convention not in xy:
        raise ValueError(f"unknown azimuth convention: {convention}")
    return (*xy[convention], rng * F.sin(elevation))


def polar_std(rng: Column, elevation: Column, range_std: float, azimuth_std: float, elevation_std: float) -> tuple[Column, Column]:
    """Horizontal and vertical standard deviations of a polar measurement, to first order."""
    cross = F.abs(rng) * F.cos(elevation) * F.lit(azimuth_std)
    xy = F.sqrt((F.lit(range_std) * F.cos(elevation)) ** 2 + cross**2)
    z = F.sqrt((F.lit(range_std) * F.sin(elevation)) ** 2 + (rng * F.cos(elevation) * F.lit(elevation_std)) ** 2)
    return xy, z


def backproject_pixel(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    return (u - F.lit(cx)) * depth / F.lit(fx), (v - F.lit(cy)) * depth / F.lit(fy), depth


def affine(x: Column, y: Column, z: Column, matrix, offset) -> list[Column]:
    """matrix (3 x 3) and offset: numbers or columns."""
    lit = lambda a: a if isinstance(a, Column) else F.lit(float(a))
    return [lit(r[0]) * x + lit(r[1]) * y + lit(r[2]) * z + lit(o) for r, o in zip(matrix, offset)]


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap of boxes (left, top, width, height); 0 for empty boxes."""
    w = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    both = a[2] * a[3] + b[2] * b[3] - w * h
    return F.when(both > 0, w * h / both).otherwise(F.lit(0.0))


def distance(a: list[Column], b: list[Column]) -> Column:
    total = (a[0] - b[0]) * (a[0] - b[0])
    for p, q in zip(a[1:], b[1:]):
        total = total + (p - q) * (p - q)
    return F.sqrt(total)

"""Geometry on columns: affine and stereographic maps, body-fixed and local frames, sag, areas, reflectance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 1_737_400.0


def affine(row: Column, col: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[Column, Column]:
    """x, y of a pixel: x = a col + b row + c, y = d col + e row + f."""
    return a * col + b * row + c, d * col + e * row + f


def affine_inverse(x: Column, y: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[Column, Column]:
    """row, col of a point, by determinants."""
    det = a * e - b * d
    return (a * (y - f) - d * (x - c)) / det, (e * (x - c) - b * (y - f)) / det


def stereographic(lon: Column, lat: Column, lon0: float, lat0: float, radius: float = RADIUS) -> tuple[Column, Column]:
    """Spherical stereographic x, y of degrees."""
    la, lo = F.radians(lat), F.radians(lon - lon0)
    s0, c0 = F.sin(F.radians(F.lit(lat0))), F.cos(F.radians(F.lit(lat0)))
    k = 2.0 / (1.0 + s0 * F.sin(la) + c0 * F.cos(la) * F.cos(lo))
    return radius * k * F.cos(la) * F.sin(lo), radius * k * (c0 * F.sin(la) - s0 * F.cos(la) * F.cos(lo))


def stereographic_inverse(x: Column, y: Column, lon0: float, lat0: float, radius: float = RADIUS) -> tuple[Column, Column]:
    """lon, lat in degrees; the projection's origin where the distance from it vanishes."""
    rho = F.hypot(x, y)
    c = 2.0 * F.atan2(rho, F.lit(2.0 * radius))
    s0, c0 = F.sin(F.radians(F.lit(lat0))), F.cos(F.radians(F.lit(lat0)))
    far = rho > 1e-12
    lat = F.asin(F.cos(c) * s0 + F.try_divide(y * F.sin(c) * c0, rho))
    lon = F.atan2(x * F.sin(c), rho * c0 * F.cos(c) - y * s0 * F.sin(c))
    return F.when(far, lon0 + F.degrees(lon)).otherwise(lon0), F.when(far, F.degrees(lat)).otherwise(lat0)


def stereographic_scale(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    la, lo, p = F.radians(lat), F.radians(lon - lon0), F.radians(F.lit(lat0))
    return 2.0 / (1.0 + F.sin(p) * F.sin(la) + F.cos(p) * F.cos(la) * F.cos(lo))


def stereographic_convergence(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """Degrees that a direction on the map is turned clockwise to be a bearing from north."""
    la, lo, p = F.radians(lat), F.radians(lon - lon0), F.radians(F.lit(lat0))
    return F.degrees(F.atan2(F.sin(lo) * (F.sin(la) + F.sin(p)), F.cos(la) * F.cos(p) + F.cos(lo) * (1.0 + F.sin(la) * F.sin(p))))


def body_fixed(lon: Column, lat: Column, height: Column, radius: float = RADIUS) -> tuple[Column, Column, Column]:
    r, lo, la = height + radius, F.radians(lon), F.radians(lat)
    return r * F.cos(la) * F.cos(lo), r * F.cos(la) * F.sin(lo), r * F.sin(la)


def local_frame(v: tuple[Column, Column, Column], origin: tuple[Column, Column, Column], lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """East, north and up of point v seen from origin at lon, lat."""
    dx, dy, dz = (a - b for a, b in zip(v, origin, strict=True))
    lo, la = F.radians(lon), F.radians(lat)
    flat = F.cos(lo) * dx + F.sin(lo) * dy
    return F.cos(lo) * dy - F.sin(lo) * dx, F.cos(la) * dz - F.sin(la) * flat, F.cos(la) * flat + F.sin(la) * dz


def azimuth_elevation(east: Column, north: Column, up: Column) -> tuple[Column, Column]:
    """Azimuth in [0, 360) from north over east, and elevation, in degrees."""
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)), F.degrees(F.atan2(up, F.hypot(east, north)))


def sag(distance: Column, radius: float = RADIUS) -> Column:
    return F.pow(distance, 4) / (8 * radius**3)


def drop(distance: Column, radius: float = RADIUS) -> Column:
    return distance * distance / (2 * radius)


def seen_slope(height: Column, distance: Column, eye: Column, radius: float = RADIUS) -> Column:
    """Slope of terrain from an eye: plain within 500 m, else in the plane through the body's centre."""
    z = ((height - eye) * (2 * radius + height + eye) - distance * distance) / (2 * (radius + eye))
    x = F.sqrt(distance * distance - z * z)
    return F.when(distance < 500.0, F.try_divide(height - eye, distance)).otherwise(F.try_divide(z, x))


def circular(values: Column, azimuth: Column) -> Column:
    """Value at an azimuth in degrees, linear between the centres of equal buckets around the circle."""
    n = F.size(values)
    at = azimuth / 360.0 * n - 0.5
    low = F.floor(at)
    pick = lambda i: F.get(values, F.pmod(i, n).cast("int"))
    return pick(low) * (1 - (at - low)) + pick(low + 1) * (at - low)


def polygon_area(xs: Column, ys: Column) -> Column:
    """Area of the ring of points (shoelace); under three points there is none."""
    n = F.size(xs)
    at = lambda c, i: F.get(c, i % n)
    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + at(xs, i) * at(ys, i + 1) - at(xs, i + 1) * at(ys, i))
    return F.when(n >= 3, F.abs(twice) / 2).otherwise(0.0)


def mean_pixel_size(a: Column, e: Column) -> Column:
    x, y = F.abs(a), F.abs(e)
    return F.when((x > 0) & (y > 0), (x + y) / 2).otherwise(F.greatest(x, y, F.lit(1.0)))


def remapped(c: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """Linear map of low..high to to_low..to_high, clipped."""
    t = F.least(F.greatest((c - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return to_low + t * (to_high - to_low)


def henyey_greenstein(cos_phase: Column, g: float) -> Column:
    return (1 - g * g) / F.pow(1 + 2 * g * cos_phase + g * g, F.lit(1.5))


def hapke(mu0: Column, mu: Column, cos_phase: Column, w: float, g: float, b0: float, h: float) -> Column:
    """Simplified reflectance of a particulate surface with an opposition surge, 0 where it has no value."""
    gamma = (1 - w) ** 0.5
    ambient = lambda m: (1 + 2 * m) / (1 + 2 * m * gamma)
    half = F.sqrt(F.greatest(F.lit(0.0), (1 - cos_phase) / (1 + cos_phase + 1e-12)))
    r = w / (4 * math.pi) * F.try_divide(mu0, mu0 + mu) * ((1 + b0 / (1 + half / h)) * henyey_greenstein(cos_phase, g) + ambient(mu0) * ambient(mu) - 1)
    return F.greatest(F.lit(0.0), F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)))


def segment_meets_box(x1: Column, y1: Column, x2: Column, y2: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Does a segment touch a closed box? Their extents meet, and the box's corners are not all on one side of the line."""
    side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (left, right) for y in (top, bottom)]
    extents = (F.least(x1, x2) <= right) & (F.greatest(x1, x2) >= left) & (F.least(y1, y2) <= bottom) & (F.greatest(y1, y2) >= top)
    return extents & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)


def outward(low: Column, high: Column, size: int) -> tuple[Column, Column]:
    """An extent grown to whole patches."""
    return F.floor(low / size) * size, F.ceil(high / size) * size

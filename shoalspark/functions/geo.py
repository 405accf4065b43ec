"""Places: grids, local metre frames, transverse Mercator, blend weights, codes."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Provenance codes.
PROVENANCE = {
    0: "NoData", 1: "SDB (satellite-derived)", 2: "River (cross-section interpolation)", 3: "Measured (sonar/lidar/survey)", 4: "Existing DEM",
    5: "Averaged (multiple sources)", 6: "Blended (tapered transition)", 7: "Extrapolated (physics-based)",
    10: "Gap-fill: Prior only (no HQ nearby)", 11: "Gap-fill: Prior + residual correction", 12: "Gap-fill: At HQ measurement",
    13: "Gap-fill: River smoothed (anisotropic)", 14: "Gap-fill: Bank constrained",
}
# WGS 84 and the scale of UTM's central meridian.
SEMI_MAJOR, FLATTENING, UTM_SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def grid_row(y: Column, y0: float, dy: float) -> Column:
    return F.floor((y0 - y) / dy).cast("int")


def grid_col(x: Column, x0: float, dx: float) -> Column:
    return F.floor((x - x0) / dx).cast("int")


def metres_per_degree(latitude: Column) -> tuple[Column, Column]:
    """Of longitude and latitude, in a local equirectangular frame."""
    return 111_320.0 * F.cos(F.radians(latitude)), F.lit(111_320.0)


def utm_zone(longitude: Column) -> Column:
    return (F.floor((longitude + 180) / 6) + 1).cast("int")


def utm_epsg(longitude: Column, latitude: Column) -> Column:
    return utm_zone(longitude) + F.when(latitude >= 0, 32600).otherwise(32700)


@functools.cache
def _krueger() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the forward and inverse series to the fourth order in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280,
    ]
    return radius, alpha, beta


def to_utm(longitude: Column, latitude: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing of the zone (south of the equator with the false northing)."""
    radius, alpha, _ = _krueger()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(latitude), F.radians(longitude - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + UTM_SCALE * radius * east, UTM_SCALE * radius * north + F.when(latitude < 0, 10_000_000).otherwise(0)


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude by the inverse series."""
    radius, _, beta = _krueger()
    xi = (y - F.when(south, 10_000_000).otherwise(0)) / (UTM_SCALE * radius)
    eta = (x - 500_000) / (UTM_SCALE * radius)
    p, q = xi, eta
    for j, b in enumerate(beta, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    n = FLATTENING / (2 - FLATTENING)
    d1, d2, d3, d4 = 2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630
    phi = chi + d1 * F.sin(2 * chi) + d2 * F.sin(4 * chi) + d3 * F.sin(6 * chi) + d4 * F.sin(8 * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(q), F.cos(p))), F.degrees(phi)


def blend_weight(position: Column, size: int, overlap: int, mode: str = "cosine", low_side: bool = True, high_side: bool = True) -> Column:
    """Weight of a cell of a tile: ramps over ``overlap`` cells on the sides that have a neighbour."""
    ramp = lambda d: F.sin(d * (math.pi / 2)) if mode == "cosine" else d
    w = F.lit(1.0)
    if low_side:
        w = F.least(w, ramp(F.least(F.lit(1.0), (position + 1) / (overlap + 1.0))))
    if high_side:
        w = F.least(w, ramp(F.least(F.lit(1.0), (size - position) / (overlap + 1.0))))
    return w


def provenance_text(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in PROVENANCE.items() for x in kv))
    return F.coalesce(F.try_element_at(names, code), F.concat(F.lit("Unknown ("), code.cast("string"), F.lit(")")))


def nodata_to_null(value: Column, nodata: float, tolerance: float = 1e-6) -> Column:
    """Null for NaN, infinities and the sentinel."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")) & (F.abs(v - nodata) >= tolerance), value)

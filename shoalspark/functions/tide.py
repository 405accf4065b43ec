"""Tides, times and the sun."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tidal constituents, period in hours and default amplitude in metres.
CONSTITUENTS = {
    "M2": (12.4206, 0.25), "S2": (12.0, 0.10), "N2": (12.6583, 0.05), "K1": (23.9345, 0.15),
    "O1": (25.8193, 0.10), "P1": (24.0659, 0.05), "K2": (11.9672, 0.03), "Q1": (26.8684, 0.02),
}
# Tidal regions as boxes (west, east, south, north), first match counts.
TIDE_REGIONS = (
    ("atlantic_us_southeast", -82, -65, 25, 32), ("atlantic_us_east", -82, -65, 32, 45), ("gulf_mexico", -98, -80, 18, 31),
    ("pacific_us_west", -130, -115, 30, 50), ("caribbean", -90, -60, 10, 25), ("hawaii", -162, -154, 18, 23), ("mediterranean", -6, 37, 30, 46),
    ("uk_atlantic", -12, 3, 49, 61), ("australia_east", 140, 155, -40, -10), ("australia_north", 120, 140, -20, -10),
)

J2000 = "2000-01-01 12:00:00"
ATLAS_EPOCH = "2018-01-01 00:00:00"


def hours_since_j2000(time: Column) -> Column:
    return (F.unix_micros(time.cast("timestamp")) - 946728000 * 1_000_000) / 3.6e9


def harmonic_tide(longitude: Column, time: Column, tidal_range: Column | float = 1.0) -> Column:
    """Sum of eight cosines; phases follow the longitude."""
    t = hours_since_j2000(time)
    turn = longitude - F.floor(longitude / 360) * 360
    terms = [a * tidal_range * F.cos(2 * math.pi * t / p - F.radians(0.5 * turn + 30.0 * i)) for i, (p, a) in enumerate(CONSTITUENTS.values())]
    return sum(terms[1:], terms[0])


def tide_region(longitude: Column, latitude: Column) -> Column:
    out = None
    for name, w, e, s, n in TIDE_REGIONS:
        low = latitude >= s if name == "atlantic_us_east" else latitude > s
        inside = (longitude > w) & (longitude < e) & low & (latitude < n)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise("default")


def tide_corrected(depth: Column, tide: Column, reference: Column | float = 0.0) -> Column:
    return depth + (tide - reference)


def tide_error(tidal_range: Column, hours: Column) -> Column:
    """Most error of a depth taken some hours from the reference time."""
    return tidal_range / 2 * F.when(hours < 6, F.sin(math.pi * hours / 12)).otherwise(1.0)


def atlas_time(delta_time: Column) -> Column:
    """Timestamp of seconds since 2018-01-01 UTC."""
    return F.timestamp_micros((delta_time * 1e6).cast("long") + 1514764800 * 1_000_000)


def scene_time(text: Column) -> Column:
    """First of four formats that reads the text."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]X", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd'T'HHmmss")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def solar_zenith(latitude: Column, longitude: Column, day_of_year: Column, hour_utc: Column) -> Column:
    declination = F.radians(23.45 * F.sin(F.radians(360.0 * (284 + day_of_year) / 365)))
    angle = F.radians(15.0 * (hour_utc - (12.0 - longitude / 15)))
    c = F.sin(F.radians(latitude)) * F.sin(declination) + F.cos(F.radians(latitude)) * F.cos(declination) * F.cos(angle)
    return F.degrees(F.acos(F.when(c > 1, 1.0).when(c < -1, -1.0).otherwise(c)))

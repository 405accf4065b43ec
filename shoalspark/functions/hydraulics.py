"""River hydraulics: depth priors, friction inversion, guards, blends and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoalspark.functions.optics import clip

BOTTOM = 0.30
# Two-year flood Q = a * A^b (cfs, square miles) by region, and its uncertainty in per cent.
FLOOD_REGIONS = {
    "coastal_plain": (15.0, 0.75, 40.0), "piedmont": (20.0, 0.78, 35.0), "appalachian": (25.0, 0.80, 35.0), "new_england": (30.0, 0.82, 40.0),
    "interior_lowlands": (18.0, 0.76, 40.0), "great_plains": (8.0, 0.70, 50.0), "ozarks": (22.0, 0.78, 35.0), "rocky_mountain": (15.0, 0.75, 45.0),
    "pacific_northwest": (35.0, 0.85, 40.0), "california_coast": (12.0, 0.72, 50.0), "southwest_desert": (5.0, 0.65, 60.0), "default": (18.0, 0.77, 45.0),
}
FOOT, SQUARE_FOOT, CUBIC_FOOT, SQUARE_MILE = 0.3048, 0.09290304, 0.0283168, 0.386102


def trapezoid_depth(from_left: Column, width: Column, dmax: Column, bottom: float = BOTTOM) -> Column:
    side = width * (1 - bottom) / 2
    return (
        F.when((from_left < 0) | (from_left > width), 0.0)
        .when(from_left < side, dmax * from_left / side)
        .when(from_left > width - side, dmax * (width - from_left) / side)
        .otherwise(dmax)
    )


# Manning's n by bed type, by a word in it, and by region.
ROUGHNESS = {
    "clean_straight": 0.030, "clean_winding": 0.040, "clean_cobble": 0.040, "weeds_light": 0.035, "weeds_heavy": 0.050, "brush_light": 0.050, "brush_heavy": 0.100, "sand_bed": 0.030,
    "gravel_bed": 0.035, "cobble_bed": 0.045, "boulder_bed": 0.055, "mountain_clean": 0.040, "mountain_cobble": 0.050, "mountain_boulder": 0.060, "floodplain_grass": 0.035,
    "floodplain_brush": 0.070, "floodplain_trees": 0.120, "default": 0.035,
}
ROUGHNESS_WORDS = {"sand": 0.030, "gravel": 0.035, "cobble": 0.045, "boulder": 0.055}
REGION_ROUGHNESS = {
    "coastal_plain": 0.030, "piedmont": 0.035, "appalachian": 0.040, "interior_lowlands": 0.032, "great_plains": 0.028, "rocky_mountain": 0.050, "pacific_coast": 0.040, "default": 0.035,
}


def width_prior(width: Column, a: float = 0.18, b: float = 0.50, low: float = 0.5, high: float = 15.0) -> Column:
    return clip(a * F.pow(width, F.lit(b)), low, high)


def multivariate_prior(width: Column, area_km2: Column, slope: Column, a0: float = 0.18, bw: float = 0.5, ba: float = 0.05, bs: float = -0.10) -> Column:
    return clip(a0 * F.pow(width, F.lit(bw)) * F.pow(area_km2 + 1, F.lit(ba)) * F.pow(slope + 1e-4, F.lit(bs)), 0.5, 15.0)


def friction_depth(discharge: Column, width: Column, slope: Column, n: float | Column = 0.035) -> Column:
    """Mean depth of a wide channel from Manning's equation, metres."""
    return clip(F.pow(n * discharge / (width * F.sqrt(slope)), F.lit(0.6)), 0.3, 20.0)


def dmax_of_mean(mean_depth: Column, bottom: float = BOTTOM) -> Column:
    return mean_depth * 2 / (1 + bottom)


def _key(text: Column) -> Column:
    return F.translate(F.lower(text), " -", "__")


def roughness(bed_type: Column, order: Column, sinuosity: Column, region: Column | None = None) -> dict[str, Column]:
    """Manning's n from bed type, region, stream order and sinuosity, and its uncertainty; null where unknown counts as nothing said."""
    table = lambda values: F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    bed = _key(bed_type)
    part = F.lit(None).cast("double")
    for word, value in reversed(ROUGHNESS_WORDS.items()):
        part = F.when(bed.contains(word), value).otherwise(part)
    n = F.coalesce(F.try_element_at(table(ROUGHNESS), bed), part, F.lit(ROUGHNESS["default"]))
    if region is not None:
        regional = F.try_element_at(table(REGION_ROUGHNESS), _key(region))
        n = F.coalesce((n + regional) / 2, n)
    n = n * F.when(order <= 2, 1.15).when(order >= 6, 0.90).otherwise(1.0)
    n = n * F.when(sinuosity > 1, 1 + 0.05 * clip(sinuosity - 1, None, 1.0)).otherwise(1.0)
    return {"n": n, "sigma": 0.25 * n}


def backwater_guard(slope: Column, tide_m: Column, elevation_m: Column) -> dict[str, Column]:
    """Factors by which confidence in friction depths falls near the sea and on flat reaches."""
    by_slope = (
        F.when(slope.isNull() | (slope <= 0), 0.3).when(slope < 1e-4, 0.2).when(slope < 3e-4, 0.5).when(slope < 1e-3, 0.5 + 0.5 * (slope - 3e-4) / 7e-4).otherwise(1.0)
    )
    by_distance = F.when(tide_m < 5000, 0.3 + 0.4 * tide_m / 5000).when(tide_m < 15000, 0.7 + 0.3 * (tide_m - 5000) / 10000).otherwise(1.0)
    by_height = F.when(elevation_m < 3, F.greatest(F.lit(0.5), elevation_m / 3)).otherwise(1.0)
    distance = F.least(by_distance, by_height)
    reason = F.concat_ws(
        "; ",
        F.when(slope.isNull() | (slope <= 0), "invalid_slope").when(slope < 1e-4, "very_low_slope").when(slope < 3e-4, "low_slope").when(slope < 1e-3, "moderate_slope"),
        F.when(tide_m < 5000, "near_tide").when(tide_m < 15000, "transition_zone"),
        F.when(elevation_m < 1, "low_elevation"),
    )
    return {"slope_factor": by_slope, "distance_factor": distance, "combined_factor": clip(F.least(by_slope, distance), 0.1, 1.0), "reason": F.when(reason == "", "normal_flow").otherwise(reason)}


def inverted_friction(discharge: Column, width: Column, slope: Column, guard: Column, n: float = 0.035) -> dict[str, Column]:
    y = friction_depth(discharge, width, slope, n)
    return {"depth_m": y, "dmax_m": dmax_of_mean(y), "sigma_m": 0.4 * y / clip(guard, 0.3, None), "confidence": 0.7 * guard}


def two_year_flood(area_km2: Column, region: Column, precipitation_mm: Column | None = None) -> Column:
    """Two-year flood, m3/s, by the region's power law; unknown regions take the default."""
    a = b = None
    for name, (ka, kb, _) in FLOOD_REGIONS.items():
        if name != "default":
            a = F.when(region == name, ka) if a is None else a.when(region == name, ka)
            b = F.when(region == name, kb) if b is None else b.when(region == name, kb)
    a, b = a.otherwise(FLOOD_REGIONS["default"][0]), b.otherwise(FLOOD_REGIONS["default"][1])
    if precipitation_mm is not None:
        a = a * F.when(precipitation_mm.isNull(), 1.0).otherwise(F.sqrt(precipitation_mm / 1000))
    return a * F.pow(area_km2 * SQUARE_MILE, b) * CUBIC_FOOT


def blended_depth(d1: Column, c1: Column, s1: Column, d2: Column, c2: Column, s2: Column, least: float = 0.3) -> dict[str, Column]:
    """Two depths by squared confidence: the first counts from ``least`` on, the second above 0; where one doesn't, or is null, the other stands."""
    one, two = F.coalesce(d1.isNotNull() & (c1 >= least), F.lit(False)), F.coalesce(d2.isNotNull() & (c2 > 0), F.lit(False))
    w1 = F.when(one & two, c1 * c1 / (c1 * c1 + c2 * c2)).when(one, 1.0).when(two, 0.0)
    mixed = lambda a, b: F.when(one & two, w1 * a + (1 - w1) * b).when(one, a).when(two, b)
    sigma = F.when(one & two, F.sqrt(w1 * w1 * s1 * s1 + (1 - w1) * (1 - w1) * s2 * s2)).when(one, s1).when(two, s2)
    method = F.when(one & two, "blend").when(one, "first").when(two, "second").otherwise("none")
    return {"depth_m": mixed(d1, d2), "sigma_m": sigma, "confidence": F.coalesce(mixed(c1, c2), F.lit(0.0)), "method": method}


def bankfull_curve(area_km2: Column, c: float, f: float, uncertainty_pct: float = 40.0) -> dict[str, Column]:
    return {"dmax_m": c * F.pow(area_km2, F.lit(f)), "weight": F.lit(0.6 * (1 - uncertainty_pct / 100))}


# Bankfull mean depth = c * A^f (m, km2) by region, and its uncertainty in per cent.
BANKFULL_CURVES = {
    "default": (0.25, 0.30, 40.0), "coastal_plain": (0.22, 0.32, 45.0), "piedmont": (0.20, 0.33, 40.0), "appalachian": (0.18, 0.35, 45.0), "great_plains": (0.15, 0.30, 55.0),
}


def source_sigma(source: Column, n: Column, r2: Column, stage_weight: Column, cv: Column, gage_weight: Column) -> Column:
    """Standard deviation of a section's depth by what it rests on, in metres."""
    loose = lambda cond, factor: F.when(cond, factor).otherwise(1.0)
    sounded = F.greatest(F.lit(0.35), 0.9 / F.sqrt(F.greatest(n, F.lit(1))))
    staged = loose(r2 < 0.85, 1.2) * loose(stage_weight < 0.5, 1.2)
    gaged = 1.2 * loose(cv > 0.5, 1.3) * (1 + F.greatest(F.lit(0.0), 0.6 - F.coalesce(gage_weight, F.lit(0.6))))
    return clip(F.when(source == "soundings", sounded).when(source == "width_stage", staged).when(source == "gage", gaged).otherwise(1.5), 0.25, 5.0)


def width_stage_weight(n: Column, r2: Column) -> Column:
    return F.when((n >= 6) & (r2 >= 0.25), 0.8 * clip(F.sqrt(n / 12), None, 1.0) * (0.25 + 0.75 * r2)).otherwise(0.0)


def width_stage_dmax(beta: Column, width: Column, bottom: float = BOTTOM) -> Column:
    return beta * width * (1 - bottom)

"""Water optics: reflectance features, attenuation, water types, bottom reflectance, masks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper limits of diffuse attenuation at 490 nm by water type.
WATER_TYPES = (
    (0.02, "ultra_clear"), (0.06, "oceanic_clear"), (0.12, "oceanic_moderate"), (0.20, "coastal_clear"),
    (0.35, "coastal_moderate"), (0.60, "coastal_turbid"), (1.50, "estuarine"),
)
# Log-ratio depth model by region (m0, m1), typical Kd, reliable depth.
REGIONS = {
    "caribbean_clear": (-0.5, 6.5, 0.08, 25.0), "florida_keys": (-0.3, 5.5, 0.12, 18.0), "pacific_islands": (-0.4, 6.0, 0.06, 30.0),
    "temperate_coastal": (-0.2, 4.0, 0.25, 10.0), "turbid_coastal": (0.0, 2.5, 0.50, 5.0), "default": (0.0, 5.0, 0.15, 15.0),
}
# Scene classes that hide the surface.
BAD_CLASSES = (0, 3, 8, 9, 10, 11)

EPS = 1e-6


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """Bounds that keep nulls (``least`` and ``greatest`` skip them)."""
    c = c if low is None else F.when(c < low, F.lit(low)).otherwise(c)
    return c if high is None else F.when(c > high, F.lit(high)).otherwise(c)


def brightness(b02: Column, b03: Column, b04: Column) -> Column:
    return (b02 + b03 + b04) / 3


def features(b02: Column, b03: Column, b04: Column, b08: Column, linf: dict[str, float]) -> dict[str, Column]:
    """Deep-water-corrected logs, ratios, brightness and indices; used to train and to predict."""
    c2, c3, c4, c8 = (clip(b - linf.get(k, 0.0), EPS, None) for b, k in ((b02, "b02"), (b03, "b03"), (b04, "b04"), (b08, "b08")))
    return {
        "log_b02": F.ln(c2), "log_b03": F.ln(c3), "log_b04": F.ln(c4), "log_b08": F.ln(c8),
        "brightness": brightness(c2, c3, c4), "b03_b02": c3 / c2, "b04_b03": c4 / c3,
        "nbri": F.try_divide(c3 - c8, c3 + c8), "stumpf_idx": clip(F.try_divide(F.ln(c2), F.ln(c3)), -10.0, 10.0),
    }


def log_ratio_depth(blue: Column, green: Column, m0: float = 0.0, m1: float = 5.0, n: float = 1000.0) -> Column:
    return m0 + F.try_divide(m1 * F.ln(clip(n * blue, EPS, None)), F.ln(clip(n * green, EPS, None)))  # in this order; thresholds tell the last bit


def linear_log_depth(bands: list[Column], coefficients: list[float], linf: list[float], intercept: float = 0.0) -> Column:
    return sum((k * F.ln(clip(b - d, EPS, None)) for b, k, d in zip(bands, coefficients, linf, strict=True)), F.lit(intercept))


def attenuation(blue: Column, green: Column, algorithm: str = "polynomial") -> Column:
    """Kd(490) by one of four published relations, within [0.01, 5]."""
    ratio = clip(blue, EPS, None) / clip(green, EPS, None)
    r = F.log10(ratio)
    if algorithm == "polynomial":
        kd = F.pow(F.lit(10.0), -0.8813 - 2.0584 * r + 2.5878 * r * r - 3.4885 * r * r * r + 1.5061 * r * r * r * r)
    elif algorithm == "ratio":
        kd = 0.0166 + 0.0773 / ratio
    elif algorithm == "chlorophyll":
        chl = F.pow(F.lit(10.0), 0.283 - 2.753 * r + 1.457 * r * r + 0.659 * r * r * r - 1.403 * r * r * r * r)
        kd = 0.0166 + 0.0395 * F.pow(chl, F.lit(0.79))
    else:
        kd = 0.05 + 0.15 * F.exp(-2.5 * ratio)
    return clip(kd, 0.01, 5.0)


def attenuation_from_deep(linf: Column, surface: Column) -> Column:
    """Kd proxy from the ratio of deep to surface reflectance."""
    return clip(-F.ln(clip(linf / clip(surface, EPS, None), 1e-6, 1 - 1e-6)) / 2, 0.01, 5.0)


def water_type(kd: Column) -> Column:
    out = F.when(kd < WATER_TYPES[0][0], WATER_TYPES[0][1])
    for limit, name in WATER_TYPES[1:]:
        out = out.when(kd < limit, name)
    return out.otherwise(F.when(kd.isNotNull(), "highly_turbid"))


def depth_limit(kd: Column, factor: float, cap: float = 50.0) -> Column:
    return F.round(clip(factor / clip(kd, 0.01, None), None, cap), 1)


def depth_confidence(kd: Column, depth: Column, model: str = "exponential") -> Column:
    ratio = F.abs(depth) / clip(2.3 / kd, 0.1, None)
    inside = F.exp(-2 * ratio) if model == "exponential" else clip(1 - ratio, 0.0, 1.0)
    return F.when(ratio > 1.5, 0.0).otherwise(inside)


def slant(k: Column, zenith_deg: Column, index: float = 1.34) -> Column:
    """Attenuation along a ray refracted into the water."""
    return k / clip(F.cos(F.asin(F.sin(F.radians(zenith_deg)) / index)), 0.1, None)


def path_attenuation(kd: Column, ku: Column, depth: Column) -> Column:
    return F.exp(-(kd + ku) * F.abs(depth))


def bottom_reflectance(rrs: Column, deep: Column, attenuated: Column) -> Column:
    return clip(math.pi * (rrs - deep * (1 - attenuated)) / clip(attenuated, EPS, None), 0.0, 1.0)


def water_index(temperature: float = 20.0, wavelength: float = 532.0) -> float:
    """Refractive index of sea water."""
    return -1.5015625e-6 * temperature**2 + 1.07084865e-7 * wavelength**2 - 4.2759374989e-5 * temperature - 1.60475520686e-4 * wavelength + 1.398067112092424


def refracted_depth(apparent: Column, theta_air: Column, temperature: float = 20.0, wavelength: float = 532.0) -> Column:
    n = water_index(temperature, wavelength)
    sine = 1.00029 / n * F.sin(theta_air)
    return apparent * F.sqrt(1 - sine * sine) / F.cos(theta_air) / n


def deep_water(b08: Column, bright: Column, b02: Column | None = None, nir_max: float = 0.03, bright_max: float = 0.15, b02_max: float = 0.20) -> Column:
    mask = (b08 < nir_max) & (bright < bright_max)
    return mask if b02 is None else mask & (b02 < b02_max)


def clear_water(b08: Column, bright: Column, nir_max: float = 0.05, bright_max: float = 0.18) -> Column:
    return (b08 < nir_max) & (bright < bright_max)


def visible_class(scl: Column) -> Column:
    return ~scl.isin(*BAD_CLASSES)


def water_pixel_valid(b02: Column, b03: Column, b04: Column, b08: Column, scl: Column, blue_max: float = 0.25, bright_shallow: bool = True, turbidity: bool = True) -> Column:
    """Land keeps its base validity; water must be dark in blue (or bright shallow sand) and not turbid."""
    ok = (b02 < blue_max) | ((b08 < 0.03) if bright_shallow else F.lit(False))
    if turbidity:
        ok = ok & (b08 < 0.12) & (b08 / b03 < 0.60) & (b04 < 0.08)
    return visible_class(scl) & ((scl != 6) | ok)


def hybrid_depth(forest: Column, spread: Column, physical: Column, trained_max: float) -> Column:
    """Forest depth, pulled to the index depth beyond the training edge."""
    edge = clip((forest - 0.7 * trained_max) / (0.3 * trained_max + 0.1), 0.0, 1.0)
    w = F.when(physical > forest, F.greatest(0.3 * clip(spread / 0.25, 0.0, 1.0), edge * clip(physical - forest, 0.0, 1.0))).otherwise(0.0)
    return (1 - w) * forest + w * physical


def physics_blend(forest: Column, spread: Column, physical: Column, physical_sigma: Column, trained_max: float, start: float | None = None) -> dict[str, Column]:
    """Forest depth drawn to a deeper physical one near and beyond the trained depths, or where trees disagree; sigmas add as variances.

    ``start`` is the depth at which the pull begins, four fifths of the trained maximum by default. Beyond the maximum a tenth of the excess is added to sigma.
    """
    start = 0.8 * trained_max if start is None else start
    near_edge = clip((forest - start) / (trained_max - start + 0.1), 0.0, 1.0)
    w = F.when(physical > forest, F.greatest(near_edge, 0.5 * clip(spread / 0.3, 0.0, 1.0))).otherwise(0.0)
    depth = (1 - w) * forest + w * physical
    own = F.greatest(spread, F.lit(0.1))
    sigma = F.sqrt((1 - w) * (1 - w) * own * own + w * w * physical_sigma * physical_sigma) + 0.1 * clip(depth - trained_max, 0.0, None)
    return {"depth_m": depth, "sigma_m": sigma, "weight": w}

"""Variance terms of a depth, their sum, and a confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoalspark.functions.optics import clip

# Base standard deviation of a model by how it was fitted, in metres.
MODEL_SIGMA = {"calibrated": 0.10, "transfer": 0.25, "physics": 0.40, "uncalibrated": 0.80}


def model_variance(mode: str, spread: Column | None = None) -> Column:
    base = F.lit(MODEL_SIGMA[mode] ** 2)
    return base if spread is None else base + spread * spread


def optical_variance(kd: Column, depth: Column) -> Column:
    return F.pow(0.05 + 0.15 * F.abs(kd * depth), F.lit(2.0))


def depth_variance(depth: Column) -> Column:
    return F.pow(0.03 * F.abs(depth), F.lit(2.0))


def extrapolation_variance(depth: Column, trained_max: float, outside: Column) -> Column:
    """Metres beyond the trained depth, and the number of features outside their bounds."""
    return F.pow(0.20 * clip(F.abs(depth) - trained_max, 0.0, None), F.lit(2.0)) + F.pow(0.30 * outside, F.lit(2.0))


def spatial_variance(distance_m: Column) -> Column:
    return F.pow(0.10 + 0.05 * clip(distance_m / 1000, None, 50.0), F.lit(2.0))


def input_variance(sigma: float = 0.08) -> Column:
    return F.lit(sigma**2)


def combined_sigma(*terms: Column, low: float = 0.05, high: float = 10.0) -> Column:
    return clip(F.sqrt(sum(terms[1:], terms[0])), low, high)


def confidence(sigma: Column, depth: Column, kd: Column | None = None, trained_max: float | None = None) -> Column:
    """Falls with relative uncertainty, and in steps with optical depth and extrapolation."""
    c = 1 / (1 + sigma / (depth + 0.5) * 0.3)
    if kd is not None:
        c = c * F.when(kd * depth > 4, 0.15).when(kd * depth > 3, 0.5).otherwise(1.0)
    if trained_max is not None:
        ratio = depth / max(trained_max, 1.0)
        c = c * F.when(ratio > 2, 0.03).when(ratio > 1.5, 0.3).otherwise(1.0)
    return clip(c, 0.0, 1.0)

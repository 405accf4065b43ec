"""From raw sections to depths and beds: levels, widths, slopes, priors by curves and friction, calibration, points between the banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.functions import hydraulics as hy
from shoalspark.functions.optics import clip
from shoalspark.operators import profiles, sections
from shoalspark.session import shuffled

#: Reach attributes that a chain may use.
ATTRIBUTES = ("drain_area_km2", "slope_mpm", "discharge_m3s", "mouth_km")


def banked_sections(samples: DataFrame, lines: DataFrame) -> DataFrame:
    """``lines`` (xs_id, ...) that have both banks, with ``left_m, right_m, width_m, left_z, right_z, bank_min_m, wse_m``.

    ``samples``: xs_id, dist_m, z (of the fine raster), z_second, is_left, is_right. A bank's height
    is that of its flag: the second raster's where the first has none.
    """
    height = F.coalesce("z", "z_second")
    placed = sections.bank_positions(samples).where(F.col("left_m").isNotNull() & F.col("right_m").isNotNull())
    tops = samples.groupBy("xs_id").agg(
        F.min_by(height, F.when(F.col("is_left"), F.col("dist_m"))).alias("left_z"), F.max_by(height, F.when(F.col("is_right"), F.col("dist_m"))).alias("right_z")
    )
    levels = sections.water_levels(samples, tops)
    return lines.join(shuffled(placed), "xs_id").join(shuffled(tops), "xs_id").withColumn("bank_min_m", F.least("left_z", "right_z")).join(shuffled(levels), "xs_id")


def with_reach_attributes(x: DataFrame, reaches: DataFrame | None) -> DataFrame:
    """Attributes of the sections' reaches (one row a river_id); what isn't there is null. No reach's slope: that of the fitted water surface, or of the smoothed levels."""
    had = set(reaches.columns) if reaches is not None else set()
    x = x.drop(*ATTRIBUTES)
    if reaches is not None:
        x = x.join(reaches.select("river_id", *(F.col(a).cast("double").alias(a) for a in ATTRIBUTES if a in had)), "river_id", "left")
    x = x.withColumns({a: F.lit(None).cast("double") for a in ATTRIBUTES if a not in had})
    if "slope_mpm" in had and not x.where(F.col("slope_mpm").isNotNull()).isEmpty():
        return x
    fitted = profiles.surface_profile(x.select("xs_id", "river_id", "s_center_m", "wse_m")).select("xs_id", F.col("slope").alias("_fit"))
    smooth = profiles.rolling_smooth(x.select("xs_id", "river_id", "s_center_m", "wse_m"), "river_id", "s_center_m", "wse_m", 9, 4)
    proxy = profiles.central_slope(smooth, "river_id", "s_center_m", "smooth").select("xs_id", F.col("slope").alias("_proxy"))
    some = fitted.agg(F.count("_fit").alias("_fits"))  # one row
    both = x.drop("slope_mpm").join(shuffled(fitted), "xs_id", "left").join(shuffled(proxy), "xs_id", "left").crossJoin(F.broadcast(some))
    return both.withColumn("slope_mpm", F.when(F.col("_fits") > 0, F.col("_fit")).otherwise(F.col("_proxy"))).drop("_fit", "_proxy", "_fits")


def _toward(now: Column, other: Column, weight: Column) -> Column:
    """``now`` moved towards ``other`` by its weight; where either is null or the weight isn't above 0, ``now``."""
    return F.when(other.isNotNull() & (weight > 0), (1 - weight) * now + weight * other).otherwise(now)


def depth_priors(
    x: DataFrame, multivariate: bool = False, curve: tuple[float, float, float] | str | None = None, discharge: str | float | None = None,
    region: str = "default", roughness: float = 0.035, low: float = 0.5, high: float = 15.0, least_area: float = 1.0, flat: float = 1e-4, mouth: float = 10.0, most: float = 0.6,
) -> DataFrame:
    """Adds ``prior_m`` and what it rests on: ``curve_m, curve_weight, discharge_used, friction_m, friction_weight``.

    The width's power law, or that of width, area and slope; then, each by its weight, the bankfull
    curve (c, f, uncertainty in per cent, or a region's) on areas from ``least_area`` km2, and the depth by friction. ``discharge``: a
    number, ``"field"`` (discharge_m3s of the reach) or ``"two_year"`` (the region's flood on the area). Friction
    counts by its confidence on slopes from ``flat`` and further than ``mouth`` km from the mouth.
    """
    width, area, slope = F.col("width_m"), F.col("drain_area_km2"), F.col("slope_mpm")
    start = hy.width_prior(width, low=low, high=high)
    if multivariate:
        start = F.coalesce(hy.multivariate_prior(width, area, slope), start)
    x = x.withColumn("prior_m", start)
    none = F.lit(None).cast("double")
    curve_m, curve_w = none, F.lit(0.0)
    if curve is not None:
        c, f, unsure = hy.BANKFULL_CURVES.get(curve, hy.BANKFULL_CURVES["default"]) if isinstance(curve, str) else curve
        by_curve = hy.bankfull_curve(area, c, f, unsure)
        curve_m = F.when(area >= least_area, clip(hy.dmax_of_mean(by_curve["dmax_m"]), low, high))
        curve_w = F.when(area >= least_area, by_curve["weight"]).otherwise(0.0)
    x = x.withColumns({"curve_m": curve_m, "curve_weight": curve_w})
    x = x.withColumn("prior_m", _toward(F.col("prior_m"), F.col("curve_m"), F.col("curve_weight")))
    q = {None: none, "field": F.col("discharge_m3s"), "two_year": hy.two_year_flood(area, F.lit(region))}.get(discharge) if discharge is None or isinstance(discharge, str) else F.lit(float(discharge))
    if q is None:
        raise ValueError(f"no such discharge: {discharge}")
    x = x.withColumn("discharge_used", F.when(q > 0, q))
    by_friction = hy.inverted_friction(F.col("discharge_used"), width, slope, hy.backwater_guard(slope, none, none)["combined_factor"], roughness)
    runs = (width > 0) & (slope >= flat) & F.coalesce(F.col("mouth_km") > mouth, F.lit(True)) & F.col("discharge_used").isNotNull()
    weight = F.when(runs & (by_friction["confidence"] >= 0.3), clip(most * most * by_friction["confidence"], 0.0, 1.0)).otherwise(0.0)
    x = x.withColumns({"friction_m": F.when(runs, clip(by_friction["dmax_m"], low, high)), "friction_weight": weight})
    return x.withColumn("prior_m", _toward(F.col("prior_m"), F.col("friction_m"), F.col("friction_weight")))


def calibrated_depths(
    x: DataFrame, measurements: DataFrame, soundings: DataFrame | None = None, group: str = "river_id", window: int = 7, low: float = 0.5, high: float = 15.0,
    cv_warn: float = 0.5, ratio_most: float = 3.0, most_m: float = 5000.0,
) -> DataFrame:
    """Adds ``depth_source, calibrations, depth_raw_m, depth_m, sigma_m, bed_m`` to sections (xs_id, ``group``, s_center_m, width_m, wse_m, bank_min_m, site_no; site_m and prior_m where there are).

    Soundings (xs_id, n, median_m) replace the prior. Where none are, the width-stage slope of the
    site blends in (from measurements up to 1.15 times the median bank width of its three sections or more),
    then the site's measured areas, less so with unstable coefficients or a bank width far above the
    measured ones. Sites further than ``most_m`` don't count. Then clipping, smoothing along the
    river, and a bed 5 cm below the lower bank at most. Measurements are few a site.
    """
    if "prior_m" not in x.columns:
        x = x.withColumn("prior_m", hy.width_prior(F.col("width_m"), low=low, high=high))
    near = F.col("site_m") <= most_m if "site_m" in x.columns else F.lit(True)
    x = x.withColumn("_site", F.when(near, F.col("site_no")))
    bank = x.where(F.col("_site").isNotNull()).groupBy("_site").agg(F.percentile("width_m", F.lit(0.5)).alias("_wb"), F.count(F.lit(1)).alias("_sections"))
    m = measurements.withColumnRenamed("site_no", "_site").withColumn("_w", F.col("width_ft") * hy.FOOT)
    fits = m.join(bank, "_site").where((F.col("_sections") >= 3) & (F.col("_w") > 0) & (F.col("_w") <= 1.15 * F.col("_wb")))
    stage = F.col("stage_ft") * hy.FOOT
    slope = fits.groupBy("_site").agg(F.regr_slope(stage, F.col("_w")).alias("_beta"), F.regr_r2(stage, F.col("_w")).alias("_r2"), F.regr_count(stage, F.col("_w")).alias("_ws_n"))
    q = m.groupBy("_site").agg(F.percentile("discharge_cfs", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    calm = m.join(q, "_site").where(F.col("discharge_cfs").between(F.get("_q", F.lit(0)), F.get("_q", F.lit(1))) & (F.col("_w") > 0))
    k = hy.dmax_of_mean(F.col("area_sqft") * hy.SQUARE_FOOT / F.col("_w")) / F.sqrt("_w")
    site = calm.groupBy("_site").agg(F.percentile(k, F.lit(0.5)).alias("_a"), (F.stddev_samp(k) / F.avg(k)).alias("_cv"), F.percentile("_w", F.lit(0.5)).alias("_wm"), F.count(k).alias("_gage_n")).where("_gage_n >= 3")
    for part in (bank, slope, site):
        x = x.join(part, "_site", "left")
    if soundings is not None:
        x = x.join(shuffled(soundings.select("xs_id", F.col("n").alias("_sn"), F.col("median_m").alias("_sd"))), "xs_id", "left")
    else:
        x = x.withColumns({"_sn": F.lit(None).cast("long"), "_sd": F.lit(None).cast("double")})
    sounded = F.coalesce(F.col("_sn") > 0, F.lit(False))
    by_stage = F.when(F.col("_beta") > 0, hy.width_stage_dmax(F.col("_beta"), F.col("_wb")))
    x = x.withColumn("_stage_w", F.when(~sounded & (by_stage > 0), hy.width_stage_weight(F.col("_ws_n"), F.col("_r2"))).otherwise(0.0))
    x = x.withColumn("_d", F.when(sounded, F.col("_sd")).otherwise(_toward(F.col("prior_m"), clip(by_stage, low, high), F.col("_stage_w"))))
    ratio = F.col("_wb") / F.col("_wm")
    x = x.withColumn("_gage_w", F.when(ratio > ratio_most, ratio_most / ratio).otherwise(1.0) * F.when(F.col("_cv") > 0, F.least(F.lit(1.0), cv_warn / F.col("_cv"))).otherwise(1.0))
    gaged = ~sounded & F.col("_a").isNotNull()
    x = x.withColumn("_d", F.when(gaged, _toward(F.col("_d"), clip(F.col("_a") * F.sqrt("width_m"), low, high), F.col("_gage_w"))).otherwise(F.col("_d")))
    source = F.when(sounded, "soundings").when(gaged, "gage").when(F.col("_stage_w") > 0, "width_stage").otherwise("prior")
    count = F.when(sounded, F.col("_sn")).when(gaged, F.col("_gage_n")).when(F.col("_stage_w") > 0, F.col("_ws_n")).otherwise(0).cast("long")
    x = x.withColumns({"depth_raw_m": clip(F.col("_d"), low, high), "depth_source": source, "calibrations": count})
    x = profiles.rolling_smooth(x, group, "s_center_m", "depth_raw_m", window, max(1, window // 3)).withColumn("depth_m", F.coalesce("smooth", "depth_raw_m"))
    sigma = hy.source_sigma(F.col("depth_source"), F.col("calibrations"), F.col("_r2"), F.col("_stage_w"), F.col("_cv"), F.col("_gage_w"))
    x = x.withColumns({"sigma_m": sigma, "bed_m": F.least(F.col("wse_m") - F.col("depth_m"), F.col("bank_min_m") - 0.05)})
    return x.drop("_site", "_wb", "_sections", "_beta", "_r2", "_ws_n", "_a", "_cv", "_wm", "_gage_n", "_sn", "_sd", "_stage_w", "_d", "_gage_w", "smooth")


def bed_points(samples: DataFrame, x: DataFrame) -> DataFrame:
    """``(xs_id, dist_m, depth_m, bed_m, sigma_m)`` of the samples between the banks: a trapezoid under the water level, 5 cm below the lower bank at most."""
    banks = x.select("xs_id", F.least("left_m", "right_m").alias("_left"), F.greatest("left_m", "right_m").alias("_right"), "wse_m", "bank_min_m", F.col("depth_m").alias("_dmax"), "sigma_m")
    held = samples.select("xs_id", "dist_m").join(shuffled(banks), "xs_id").where(F.col("dist_m").between(F.col("_left"), F.col("_right")) & (F.col("_right") > F.col("_left")))
    depth = hy.trapezoid_depth(F.col("dist_m") - F.col("_left"), F.col("_right") - F.col("_left"), F.col("_dmax"))
    bed = F.when(F.col("wse_m").isNotNull(), F.least(F.col("wse_m") - F.col("_depth"), F.col("bank_min_m") - 0.05))
    return held.withColumn("_depth", depth).select("xs_id", "dist_m", F.col("_depth").alias("depth_m"), bed.alias("bed_m"), "sigma_m")


def inferred_rivers(samples: DataFrame, lines: DataFrame, measurements: DataFrame, reaches: DataFrame | None = None, soundings: DataFrame | None = None, group: str = "river_id", **priors) -> tuple[DataFrame, DataFrame]:
    """``(sections, points)``: the whole chain from raw sections (samples and lines with river_id, s_center_m, site_no) to depths of sections and beds of points; ``priors`` go to ``depth_priors``."""
    x = with_reach_attributes(banked_sections(samples, lines), reaches)
    x = calibrated_depths(depth_priors(x, **priors), measurements, soundings, group)
    return x, bed_points(samples, x)

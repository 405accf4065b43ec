"""Queries of the scalar families, filters and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalspark.functions import geo, hydraulics, optics, tide, uncertainty
from shoalspark.plans.registry import query

C = F.col
LINF = {"b02": 0.015, "b03": 0.012, "b04": 0.008, "b08": 0.004}


@query(
    "x1_optical_features", "fx_pixels", doubles="log_b02 log_b03 log_b04 log_b08 brightness b03_b02 b04_b03 nbri stumpf_idx",
    twin="""SELECT cell, ln(c2) AS log_b02, ln(c3) AS log_b03, ln(c4) AS log_b04, ln(c8) AS log_b08, (c2 + c3 + c4) / 3 AS brightness, c3 / c2 AS b03_b02, c4 / c3 AS b04_b03,
        (c3 - c8) / (c3 + c8) AS nbri, CASE WHEN ln(c3) = 0 THEN NULL ELSE greatest(-1e1, least(1e1, ln(c2) / ln(c3))) END AS stumpf_idx
        FROM (SELECT cell, greatest(b02 - 0.015, 1e-6) AS c2, greatest(b03 - 0.012, 1e-6) AS c3, greatest(b04 - 0.008, 1e-6) AS c4, greatest(b08 - 0.004, 1e-6) AS c8 FROM fx_pixels)""",
)
def _(px):
    return px.select("cell", *(v.alias(k) for k, v in optics.features(C("b02"), C("b03"), C("b04"), C("b08"), LINF).items()))


@query("x2_brightness", "fx_pixels", doubles="brightness", twin="SELECT cell, (b02 + b03 + b04) / 3 AS brightness FROM fx_pixels")
def _(px):
    return px.select("cell", optics.brightness(C("b02"), C("b03"), C("b04")).alias("brightness"))


@query("x3_log_ratio_depth", "fx_pixels", doubles="depth_m", twin="SELECT cell, -0.3 + 5.5 * ln(1e3 * b02) / ln(1e3 * b03) AS depth_m FROM fx_pixels")
def _(px):
    return px.select("cell", optics.log_ratio_depth(C("b02"), C("b03"), *optics.REGIONS["florida_keys"][:2]).alias("depth_m"))


@query("x4_linear_log_depth", "fx_pixels", doubles="depth_m", twin="SELECT cell, 1.5 - 2.0 * ln(greatest(b02 - 0.015, 1e-6)) + 1.2 * ln(greatest(b03 - 0.012, 1e-6)) AS depth_m FROM fx_pixels")
def _(px):
    return px.select("cell", optics.linear_log_depth([C("b02"), C("b03")], [-2.0, 1.2], [0.015, 0.012], 1.5).alias("depth_m"))


@query(
    "x6_attenuation", "fx_pixels", doubles="kd_a kd_b kd_c kd_d",
    twin="""SELECT cell, least(5.0, greatest(0.01, pow(10, -0.8813 - 2.0584 * r + 2.5878 * r * r - 3.4885 * r * r * r + 1.5061 * r * r * r * r))) AS kd_a,
        least(5.0, greatest(0.01, 0.0166 + 0.0773 / q)) AS kd_b,
        least(5.0, greatest(0.01, 0.0166 + 0.0395 * pow(pow(10, 0.283 - 2.753 * r + 1.457 * r * r + 0.659 * r * r * r - 1.403 * r * r * r * r), 0.79))) AS kd_c,
        least(5.0, greatest(0.01, 0.05 + 0.15 * exp(-2.5 * q))) AS kd_d FROM (SELECT cell, b02 * 1.0001e0 / b03 AS q, log10(b02 * 1.0001e0 / b03) AS r FROM fx_pixels)""",
)
def _(px):
    kinds = {"kd_a": "polynomial", "kd_b": "ratio", "kd_c": "chlorophyll", "kd_d": "exponential"}
    # the factor keeps ratios of round numbers off the edges of rounding
    return px.select("cell", *(optics.attenuation(C("b02") * 1.0001, C("b03"), k).alias(n) for n, k in kinds.items()))


@query(
    "x7_attenuation_from_deep", "fx_pixels", doubles="kd",
    twin="SELECT cell, least(5.0, greatest(0.01, -ln(least(1 - 1e-6, greatest(1e-6, 0.015 / b02))) / 2)) AS kd FROM fx_pixels",
)
def _(px):
    return px.select("cell", optics.attenuation_from_deep(F.lit(0.015), C("b02")).alias("kd"))


@query(
    "x8_water_type", "fx_pixels", doubles="limit_m",
    twin="""SELECT cell, CASE WHEN kd < 0.02 THEN 'ultra_clear' WHEN kd < 0.06 THEN 'oceanic_clear' WHEN kd < 0.12 THEN 'oceanic_moderate' WHEN kd < 0.2 THEN 'coastal_clear'
        WHEN kd < 0.35 THEN 'coastal_moderate' WHEN kd < 0.6 THEN 'coastal_turbid' WHEN kd < 1.5 THEN 'estuarine' ELSE 'highly_turbid' END AS water_type,
        least(5e1, floor(2.3 / greatest(kd, 0.01) * 10 + 0.5) / 10) AS limit_m FROM (SELECT cell, b04 * 10 AS kd FROM fx_pixels)""",
)
def _(px):
    return px.select("cell", optics.water_type(C("b04") * 10).alias("water_type"), optics.depth_limit(C("b04") * 10, 2.3).alias("limit_m"))


@query(
    "x9_depth_confidence", "fx_pixels", doubles="exponential linear",
    twin="""SELECT cell, CASE WHEN r > 1.5 THEN 0 ELSE exp(-2 * r) END AS exponential, CASE WHEN r > 1.5 THEN 0 ELSE greatest(0.0, least(1.0, 1 - r)) END AS linear
        FROM (SELECT cell, b03 * 100 / greatest(2.3 / (b04 * 10), 0.1) AS r FROM fx_pixels)""",
)
def _(px):
    kd, z = C("b04") * 10, C("b03") * 100
    return px.select("cell", optics.depth_confidence(kd, z).alias("exponential"), optics.depth_confidence(kd, z, "linear").alias("linear"))


@query(
    "x10_x12_bottom_reflectance", "fx_pixels", doubles="kd ku path rho",
    twin="""SELECT cell, kd, ku, path, greatest(0.0, least(1.0, pi() * (b03 - 0.012 * (1 - path)) / greatest(path, 1e-6))) AS rho FROM (SELECT *, exp(-(kd + ku) * 4) AS path FROM (
        SELECT cell, b03, b04 / greatest(cos(asin(sin(radians(30 + pcol % 40)) / 1.34)), 0.1) AS kd, b04 / greatest(cos(asin(sin(radians(5.0)) / 1.34)), 0.1) AS ku FROM fx_pixels))""",
)
def _(px):
    t = px.withColumns({"kd": optics.slant(C("b04"), 30 + C("pcol") % 40), "ku": optics.slant(C("b04"), F.lit(5.0))}).withColumn("path", optics.path_attenuation(C("kd"), C("ku"), F.lit(4.0)))
    return t.select("cell", "kd", "ku", "path", optics.bottom_reflectance(C("b03"), F.lit(0.012), C("path")).alias("rho"))


@query(
    "x13_refraction", "fx_photons", doubles="depth_sum n",
    twin="""SELECT granule, beam, count(*) AS rows_n, sum(abs(photon_height) * sqrt(1 - s * s) / cos(0.2) / n) AS depth_sum, min(n) AS n FROM (SELECT *, 1.00029 / n * sin(0.2) AS s FROM (SELECT *,
        -1.5015625e-6 * 400 + 1.07084865e-7 * 283024 - 4.2759374989e-5 * 20 - 1.60475520686e-4 * 532 + 1.398067112092424 AS n FROM fx_photons)) GROUP BY granule, beam""",
)
def _(ph):
    d = optics.refracted_depth(F.abs("photon_height"), F.lit(0.2))
    return ph.groupBy("granule", "beam").agg(F.count("*").alias("rows_n"), F.sum(d).alias("depth_sum"), F.lit(optics.water_index()).alias("n"))


_TIDE = " + ".join(f"{a} * cos(2 * pi() * t / {p} - radians(0.5 * (longitude - floor(longitude / 360) * 360) + {30.0 * i}))" for i, (p, a) in enumerate(tide.CONSTITUENTS.values()))


@query(
    "x14_x15_harmonic_tide", "fx_points", doubles="tide_m depth_msl",
    twin=f"SELECT point_id, tide_m, depth_m + tide_m AS depth_msl FROM (SELECT point_id, depth_m, {_TIDE} AS tide_m FROM (SELECT *, (epoch_us(ts) - 946728000000000) / 3.6e9 AS t FROM fx_points))",
)
def _(p):
    t = p.withColumn("tide_m", tide.harmonic_tide(C("longitude"), C("ts")))
    return t.select("point_id", "tide_m", tide.tide_corrected(C("depth_m"), C("tide_m")).alias("depth_msl"))


@query(
    "x16_j19_tide_region", "fx_points", doubles="error_m",
    twin="""SELECT point_id, CASE WHEN lon > -82 AND lon < -65 AND lat > 25 AND lat < 32 THEN 'atlantic_us_southeast' WHEN lon > -82 AND lon < -65 AND lat >= 32 AND lat < 45 THEN 'atlantic_us_east'
        WHEN lon > -98 AND lon < -80 AND lat > 18 AND lat < 31 THEN 'gulf_mexico' WHEN lon > -130 AND lon < -115 AND lat > 30 AND lat < 50 THEN 'pacific_us_west'
        WHEN lon > -90 AND lon < -60 AND lat > 10 AND lat < 25 THEN 'caribbean' WHEN lon > -162 AND lon < -154 AND lat > 18 AND lat < 23 THEN 'hawaii'
        WHEN lon > -6 AND lon < 37 AND lat > 30 AND lat < 46 THEN 'mediterranean' ELSE 'default' END AS region,
        0.75 * CASE WHEN h < 6 THEN sin(pi() * h / 12) ELSE 1 END AS error_m
        FROM (SELECT point_id, longitude + point_id % 30 AS lon, latitude - point_id % 17 AS lat, (point_id % 10) * 1.0 AS h FROM fx_points)""",
)
def _(p):
    return p.select("point_id", tide.tide_region(C("longitude") + C("point_id") % 30, C("latitude") - C("point_id") % 17).alias("region"), tide.tide_error(F.lit(1.5), C("point_id") % 10).alias("error_m"))


@query(
    "x17_epoch_time", "fx_photons",
    twin="SELECT granule, CAST(year(max(t)) AS INT) AS year_n, CAST(max(epoch_us(t)) AS BIGINT) AS last_us FROM (SELECT granule, make_timestamp(CAST(delta_time * 1000000 AS BIGINT) + 1514764800000000) AS t FROM fx_photons) GROUP BY granule",
)
def _(ph):
    t = ph.select("granule", tide.atlas_time(C("delta_time")).alias("t"))
    return t.groupBy("granule").agg(F.year(F.max("t")).alias("year_n"), F.max(F.unix_micros("t")).alias("last_us"))


@query(
    "x18_solar_zenith", "fx_points", doubles="zenith_deg",
    twin="""SELECT point_id, degrees(acos(least(1.0, greatest(-1.0, sin(radians(latitude)) * sin(d) + cos(radians(latitude)) * cos(d) * cos(radians(15.0 * (16.5 - (12.0 - longitude / 15)))))))) AS zenith_deg
        FROM (SELECT *, radians(23.45 * sin(radians(360.0 * (284 + dayofyear(ts)) / 365))) AS d FROM fx_points)""",
)
def _(p):
    return p.select("point_id", tide.solar_zenith(C("latitude"), C("longitude"), F.dayofyear("ts"), F.lit(16.5)).alias("zenith_deg"))


@query(
    "x19_x20_uncertainty", "fx_pixels", doubles="sigma_m confidence",
    twin="""SELECT cell, sigma_m, greatest(0.0, least(1.0, 1 / (1 + sigma_m / (z + 0.5) * 0.3) * CASE WHEN kd * z > 4 THEN 0.15 WHEN kd * z > 3 THEN 0.5 ELSE 1 END
        * CASE WHEN z / 6.0 > 2 THEN 0.03 WHEN z / 6.0 > 1.5 THEN 0.3 ELSE 1 END)) AS confidence FROM (SELECT *, least(10.0, greatest(0.05, sqrt(0.01 + b08 * b08 + pow(0.05 + 0.15 * kd * z, 2) + pow(0.03 * z, 2)
        + pow(0.2 * greatest(z - 6, 0), 2) + pow(0.3 * (cell % 3), 2) + pow(0.1 + 0.05 * (pcol * 100.0 / 1000), 2) + 0.0064))) AS sigma_m FROM (SELECT *, b04 * 10 AS kd, b03 * 100 AS z FROM fx_pixels))""",
)
def _(px):
    kd, z, u = C("kd"), C("z"), uncertainty
    t = px.withColumns({"kd": C("b04") * 10, "z": C("b03") * 100})
    terms = (u.model_variance("calibrated", C("b08")), u.optical_variance(kd, z), u.depth_variance(z), u.extrapolation_variance(z, 6.0, C("cell") % 3), u.spatial_variance(C("pcol") * 100.0), u.input_variance())
    return t.withColumn("sigma_m", u.combined_sigma(*terms)).select("cell", "sigma_m", u.confidence(C("sigma_m"), z, kd, 6.0).alias("confidence"))


@query(
    "x21_hybrid_depth", "fx_pixels", doubles="depth_m",
    twin="""SELECT cell, (1 - w) * rf + w * ph AS depth_m FROM (SELECT *, CASE WHEN ph > rf THEN greatest(0.3 * least(1.0, sd / 0.25), edge * least(1.0, ph - rf)) ELSE 0 END AS w FROM (
        SELECT *, greatest(0.0, least(1.0, (rf - 0.7 * 8) / (0.3 * 8 + 0.1))) AS edge FROM (SELECT cell, b03 * 90 AS rf, b02 * 90 AS ph, b08 AS sd FROM fx_pixels)))""",
)
def _(px):
    return px.select("cell", optics.hybrid_depth(C("b03") * 90, C("b08"), C("b02") * 90, 8.0).alias("depth_m"))


@query(
    "x23_trapezoid", "fx_sections", doubles="depth_m",
    twin="""SELECT xs_id, CAST(k AS INT) AS k, CASE WHEN d < w * 0.35 THEN m * d / (w * 0.35) WHEN d > w - w * 0.35 THEN m * (w - d) / (w * 0.35) ELSE m END AS depth_m
        FROM (SELECT xs_id, width_m * 1.0 AS w, depth_pred_m AS m, k, width_m * k / 10.0 AS d FROM fx_sections, (SELECT unnest(range(0, 11)) AS k))""",
)
def _(xs):
    s = xs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10))))
    return s.select("xs_id", "k", hydraulics.trapezoid_depth(C("width_m") * C("k") / 10, C("width_m"), C("depth_pred_m")).alias("depth_m"))


@query(
    "x24_depth_priors", "fx_sections", doubles="power_m multi_m",
    twin="""SELECT xs_id, least(15.0, greatest(0.5, 0.18 * pow(width_m, 0.5))) AS power_m,
        least(15.0, greatest(0.5, 0.18 * pow(width_m, 0.5) * pow(drain_area_km2 + 1, 0.05) * pow(slope_mpm + 1e-4, -0.1))) AS multi_m FROM fx_sections""",
)
def _(xs):
    return xs.select("xs_id", hydraulics.width_prior(C("width_m")).alias("power_m"), hydraulics.multivariate_prior(C("width_m"), C("drain_area_km2"), C("slope_mpm")).alias("multi_m"))


_GUARD = """SELECT *, CASE WHEN slope_mpm IS NULL OR slope_mpm <= 0 THEN 0.3 WHEN slope_mpm < 1e-4 THEN 0.2 WHEN slope_mpm < 3e-4 THEN 0.5 WHEN slope_mpm < 1e-3 THEN 0.5 + 0.5 * (slope_mpm - 3e-4) / 7e-4 ELSE 1.0 END AS sf,
    least(CASE WHEN t < 5000 THEN 0.3 + 0.4 * t / 5000 WHEN t < 15000 THEN 0.7 + 0.3 * (t - 5000) / 10000 ELSE 1.0 END, CASE WHEN e < 3 THEN greatest(0.5, e / 3) ELSE 1.0 END) AS df
    FROM (SELECT *, s_center_m AS t, wse_m - 37 AS e FROM fx_sections)"""


@query(
    "x25_x28_friction_depth", "fx_sections", doubles="depth_m dmax_m sigma_m confidence",
    twin=f"""SELECT xs_id, y AS depth_m, y * 2 / 1.3 AS dmax_m, 0.4 * y / greatest(g, 0.3) AS sigma_m, 0.7 * g AS confidence FROM (SELECT *, least(1.0, greatest(0.1, least(sf, df))) AS g,
        least(20.0, greatest(0.3, pow(0.035 * (drain_area_km2 * 0.5) / (width_m * sqrt(slope_mpm)), 0.6))) AS y FROM ({_GUARD}))""",
)
def _(xs):
    guard = hydraulics.backwater_guard(C("slope_mpm"), C("s_center_m"), C("wse_m") - 37)["combined_factor"]
    return xs.select("xs_id", *(v.alias(k) for k, v in hydraulics.inverted_friction(C("drain_area_km2") * 0.5, C("width_m"), C("slope_mpm"), guard).items()))


@query(
    "x26_roughness", "fx_sections", doubles="n sigma",
    twin="""SELECT xs_id, n, 2.5e-1 * n AS sigma FROM (SELECT xs_id, coalesce((b + r) / 2, b) * CASE WHEN xs_id % 8 <= 2 THEN 1.15e0 WHEN xs_id % 8 >= 6 THEN 9e-1 ELSE 1e0 END
        * CASE WHEN s > 1 THEN 1 + 5e-2 * least(s - 1, 1e0) ELSE 1e0 END AS n FROM (SELECT xs_id, 8e-1 + (xs_id % 20) * 1e-1 AS s, CASE xs_id % 5 WHEN 0 THEN 3e-2 WHEN 1 THEN 5e-2 END AS r,
        CASE xs_id % 4 WHEN 0 THEN 3e-2 WHEN 1 THEN 1e-1 WHEN 2 THEN 4.5e-2 ELSE 5.5e-2 END AS b FROM fx_sections))""",
)
def _(xs):
    bed = F.element_at(F.array(*map(F.lit, ("Sand bed", "brush heavy", "Cobble", "boulder-strewn"))), (C("xs_id") % 4 + 1).cast("int"))
    region = F.element_at(F.array(*map(F.lit, ("Coastal Plain", "rocky-mountain", "nowhere", None, None))), (C("xs_id") % 5 + 1).cast("int"))
    return xs.select("xs_id", *(v.alias(k) for k, v in hydraulics.roughness(bed, C("xs_id") % 8, 0.8 + (C("xs_id") % 20) * 0.1, region).items()))


@query(
    "x27_backwater_guard", "fx_sections", doubles="slope_factor distance_factor combined_factor",
    twin=f"SELECT xs_id, sf AS slope_factor, df AS distance_factor, least(1.0, greatest(0.1, least(sf, df))) AS combined_factor FROM ({_GUARD})",
)
def _(xs):
    g = hydraulics.backwater_guard(C("slope_mpm"), C("s_center_m"), C("wse_m") - 37)
    return xs.select("xs_id", *(g[k].alias(k) for k in ("slope_factor", "distance_factor", "combined_factor")))


@query(
    "x29_two_year_flood", "fx_sections", doubles="q2_m3s",
    twin="""SELECT xs_id, CASE river_id % 3 WHEN 0 THEN 20.0 WHEN 1 THEN 5.0 ELSE 18.0 END * sqrt((600 + xs_id % 900) / 1000.0) * pow(drain_area_km2 * 0.386102, CASE river_id % 3 WHEN 0 THEN 0.78 WHEN 1 THEN 0.65 ELSE 0.77 END) * 0.0283168 AS q2_m3s
        FROM fx_sections""",
)
def _(xs):
    region = F.element_at(F.array(*map(F.lit, ("piedmont", "southwest_desert", "elsewhere"))), (C("river_id") % 3 + 1).cast("int"))
    return xs.select("xs_id", hydraulics.two_year_flood(C("drain_area_km2"), region, 600 + C("xs_id") % 900).alias("q2_m3s"))


@query(
    "x30_blended_depth", "fx_sections", doubles="depth_m sigma_m confidence",
    twin="""SELECT xs_id, CASE WHEN m = 'blend' THEN w * d1 + (1 - w) * d2 WHEN m = 'first' THEN d1 WHEN m = 'second' THEN d2 END AS depth_m,
        CASE WHEN m = 'blend' THEN sqrt(w * w * 25e-2 + (1 - w) * (1 - w) * 64e-2) WHEN m = 'first' THEN 5e-1 WHEN m = 'second' THEN 8e-1 END AS sigma_m,
        CASE WHEN m = 'blend' THEN w * c + (1 - w) * 6e-1 WHEN m = 'first' THEN c WHEN m = 'second' THEN 6e-1 ELSE 0e0 END AS confidence, m AS method FROM (SELECT *, c * c / (c * c + 36e-2) AS w,
        CASE WHEN d1 IS NOT NULL AND c >= 3e-1 AND d2 IS NOT NULL THEN 'blend' WHEN d1 IS NOT NULL AND c >= 3e-1 THEN 'first' WHEN d2 IS NOT NULL THEN 'second' ELSE 'none' END AS m FROM (
        SELECT xs_id, CASE WHEN xs_id % 7 > 0 THEN depth_pred_m END AS d1, CASE WHEN xs_id % 6 > 0 THEN width_m / 5e1 END AS d2, (xs_id % 10) / 1e1 AS c FROM fx_sections))""",
)
def _(xs):
    first, second = F.when(C("xs_id") % 7 > 0, C("depth_pred_m")), F.when(C("xs_id") % 6 > 0, C("width_m") / 50)
    return xs.select("xs_id", *(v.alias(k) for k, v in hydraulics.blended_depth(first, C("xs_id") % 10 / 10, F.lit(0.5), second, F.lit(0.6), F.lit(0.8)).items()))


@query("x31_bankfull_curve", "fx_sections", doubles="dmax_m weight", twin="SELECT xs_id, 0.4 * pow(drain_area_km2, 0.3) AS dmax_m, 0.36 AS weight FROM fx_sections")
def _(xs):
    return xs.select("xs_id", *(v.alias(k) for k, v in hydraulics.bankfull_curve(C("drain_area_km2"), 0.4, 0.3).items()))


@query(
    "x32_width_stage_weight", "fx_sections", doubles="weight dmax_m",
    twin="SELECT xs_id, CASE WHEN n >= 6 AND r >= 0.25 THEN 0.8 * least(1.0, sqrt(n / 12.0)) * (0.25 + 0.75 * r) ELSE 0 END AS weight, 0.02 * width_m * 0.7 AS dmax_m FROM (SELECT *, xs_id % 20 AS n, (xs_id % 9) / 8.0 AS r FROM fx_sections)",
)
def _(xs):
    return xs.select("xs_id", hydraulics.width_stage_weight(C("xs_id") % 20, C("xs_id") % 9 / 8).alias("weight"), hydraulics.width_stage_dmax(F.lit(0.02), C("width_m")).alias("dmax_m"))


@query(
    "x33_units", "fx_measurements", doubles="width_m stage_m discharge_m3s mean_depth_m",
    twin="SELECT meas_id, width_ft * 0.3048 AS width_m, stage_ft * 0.3048 AS stage_m, discharge_cfs * 0.0283168 AS discharge_m3s, area_sqft * 0.09290304 / (width_ft * 0.3048) AS mean_depth_m FROM fx_measurements",
)
def _(m):
    h = hydraulics
    return m.select(
        "meas_id", (C("width_ft") * h.FOOT).alias("width_m"), (C("stage_ft") * h.FOOT).alias("stage_m"), (C("discharge_cfs") * h.CUBIC_FOOT).alias("discharge_m3s"),
        (C("area_sqft") * h.SQUARE_FOOT / (C("width_ft") * h.FOOT)).alias("mean_depth_m"),
    )


@query(
    "x34_local_frame", "fx_points", doubles="x_m y_m",
    twin="SELECT point_id, (longitude + 88) * 111320.0 * cos(radians(latitude)) AS x_m, (latitude - 30) * 111320.0 AS y_m, CAST(floor((3.4e6 - y) / 30) AS INT) AS grow, CAST(floor((x - 5e5) / 30) AS INT) AS gcol FROM fx_points",
)
def _(p):
    mx, my = geo.metres_per_degree(C("latitude"))
    return p.select("point_id", ((C("longitude") + 88) * mx).alias("x_m"), ((C("latitude") - 30) * my).alias("y_m"), geo.grid_row(C("y"), 3.4e6, 30).alias("grow"), geo.grid_col(C("x"), 5e5, 30).alias("gcol"))


@query("x35_utm", "fx_points")
def _(p):
    x, y = geo.to_utm(C("longitude"), C("latitude"), geo.utm_zone(C("longitude")))
    t = p.select("point_id", "longitude", "latitude", geo.utm_epsg(C("longitude"), C("latitude")).alias("epsg"), x.alias("easting"), y.alias("northing"))
    lon, lat = geo.from_utm(C("easting"), C("northing"), geo.utm_zone(C("longitude")), C("latitude") < 0)
    return t.withColumns({"back_lon": lon, "back_lat": lat})


@query("x36_depth_sign", "fx_points", doubles="depth_m", twin="SELECT point_id, CASE WHEN (SELECT median(depth_m) FROM fx_points) < 0 THEN -depth_m ELSE depth_m END AS depth_m FROM fx_points")
def _(p):
    sign = p.agg(F.median("depth_m").alias("_m"))
    return p.crossJoin(F.broadcast(sign)).select("point_id", F.when(C("_m") < 0, -C("depth_m")).otherwise(C("depth_m")).alias("depth_m"))


@query(
    "x38_blend_weights", "fx_pixels", doubles="cosine linear",
    twin="""SELECT cell, least(sin(least(1.0, (p + 1) / 9.0) * pi() / 2), sin(least(1.0, (32 - p) / 9.0) * pi() / 2)) AS cosine, least(least(1.0, (p + 1) / 9.0), least(1.0, (32 - p) / 9.0)) AS linear FROM (SELECT cell, pcol % 32 AS p FROM fx_pixels)""",
)
def _(px):
    return px.select("cell", geo.blend_weight(C("pcol") % 32, 32, 8).alias("cosine"), geo.blend_weight(C("pcol") % 32, 32, 8, "linear").alias("linear"))


@query("x40_provenance_text", "fx_pixels", twin="SELECT cell, CASE scl WHEN 0 THEN 'NoData' WHEN 3 THEN 'Measured (sonar/lidar/survey)' WHEN 9 THEN 'Unknown (9)' ELSE 'other' END AS label FROM fx_pixels")
def _(px):
    return px.select("cell", F.when(C("scl").isin(0, 3, 9), geo.provenance_text(C("scl"))).otherwise("other").alias("label"))


@query("x43_bin_spec", "fx_scenes", twin="SELECT scene_id, CAST(scene_id % 7 AS BIGINT) + 2 AS edges_n, 0.0 + scene_id % 7 AS last_edge FROM fx_scenes", doubles="last_edge")
def _(s):
    spec = F.concat(F.lit("0, 9,"), F.array_join(F.transform(F.sequence(F.lit(0), (C("scene_id") % 7).cast("int")), lambda i: i.cast("string")), ","))
    edges = F.array_sort(F.array_distinct(F.transform(F.split(spec, ","), lambda v: F.trim(v).cast("double"))))
    return s.select("scene_id", F.size(edges).cast("long").alias("edges_n"), F.element_at(edges, -2).alias("last_edge"))


@query("f9_f12_f13_masks", "fx_pixels", twin="""SELECT cell, scl NOT IN (0, 3, 8, 9, 10, 11) AS clear_class, b08 < 0.03 AND (b02 + b03 + b04) / 3 < 0.15 AS deep, b08 < 0.05 AND (b02 + b03 + b04) / 3 < 0.18 AS clear_water FROM fx_pixels""")
def _(px):
    b = optics.brightness(C("b02"), C("b03"), C("b04"))
    return px.select("cell", optics.visible_class(C("scl")).alias("clear_class"), optics.deep_water(C("b08"), b).alias("deep"), optics.clear_water(C("b08"), b).alias("clear_water"))


@query(
    "f10_pixel_gating", "fx_pixels",
    twin="SELECT cell, scl NOT IN (0, 3, 8, 9, 10, 11) AND (scl <> 6 OR ((b02 < 0.25 OR b08 < 0.03) AND b08 < 0.12 AND b08 / b03 < 0.6 AND b04 < 0.08)) AS valid FROM fx_pixels",
)
def _(px):
    return px.select("cell", optics.water_pixel_valid(C("b02"), C("b03"), C("b04"), C("b08"), C("scl")).alias("valid"))


@query("f11_reflectance_scale", "fx_stack", doubles="b02_sum", twin="SELECT day_no, sum(CASE WHEN p > 0.1 THEN b02 / 10 ELSE b02 END) AS b02_sum FROM fx_stack JOIN (SELECT day_no, quantile_cont(b02, 0.99) AS p FROM fx_stack GROUP BY day_no) USING (day_no) GROUP BY day_no")
def _(st):
    p = st.groupBy("day_no").agg(F.percentile("b02", F.lit(0.99)).alias("p"))
    return st.join(p, "day_no").groupBy("day_no").agg(F.sum(F.when(C("p") > 0.1, C("b02") / 10).otherwise(C("b02"))).alias("b02_sum"))


@query("f17_depth_limits", "fx_pixels", doubles="depth_m", twin="SELECT cell, CASE WHEN b03 * 200 <= least(50, 2.3 / (b04 * 10)) THEN -b03 * 200 END AS depth_m FROM fx_pixels")
def _(px):
    z = C("b03") * 200
    return px.select("cell", F.when(z <= F.least(F.lit(50.0), 2.3 / (C("b04") * 10)), -z).alias("depth_m"))


@query("f25_nodata", "fx_pixels", twin="SELECT cell, CASE WHEN scl = 11 THEN NULL ELSE scl END AS scl FROM fx_pixels")
def _(px):
    return px.select("cell", geo.nodata_to_null(C("scl"), 11).alias("scl"))

"""Queries of river depths from raw sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalspark.operators import pipelines, rivers
from shoalspark.plans.registry import query

C = F.col

#: Calibration, smoothing and bed of the sections in ``x`` (prior_m, site, ...), as tables ``bank`` to ``done``.
_CALIBRATED = """bank AS (SELECT site, median(width_m) AS wb, count(*) AS sections FROM x WHERE site IS NOT NULL GROUP BY site),
    m AS (SELECT * REPLACE (CASE WHEN site_no % 5 <> 1 THEN area_sqft END AS area_sqft), width_ft * 0.3048 AS w FROM fx_measurements),
    ws AS (SELECT site, regr_slope(stage_ft * 0.3048, w) AS beta, regr_r2(stage_ft * 0.3048, w) AS r2, count(*) AS n FROM m JOIN bank ON site = site_no WHERE sections >= 3 AND w > 0 AND w <= 1.15 * wb GROUP BY site),
    q AS (SELECT site_no, quantile_cont(discharge_cfs, 0.25) AS q1, quantile_cont(discharge_cfs, 0.75) AS q3 FROM m GROUP BY site_no),
    k AS (SELECT site_no, w, area_sqft * 0.09290304 / w * 2 / 1.3 / sqrt(w) AS k FROM m JOIN q USING (site_no) WHERE discharge_cfs BETWEEN q1 AND q3 AND w > 0),
    site AS (SELECT site_no, median(k) AS a, stddev_samp(k) / avg(k) AS cv, median(w) AS wm, count(k) AS gn FROM k GROUP BY site_no HAVING count(k) >= 3),
    j AS (SELECT x.*, wb, beta, r2, n AS wn, a, cv, wm, gn, sn, sd, coalesce(sn > 0, false) AS sounded, CASE WHEN beta > 0 THEN beta * wb * 0.7 END AS by_stage
        FROM x LEFT JOIN bank USING (site) LEFT JOIN ws USING (site) LEFT JOIN site ON site_no = x.site LEFT JOIN (SELECT xs_id, 3 AS sn, depth_pred_m AS sd FROM fx_sections WHERE xs_id % 9 = 0) USING (xs_id)),
    sw AS (SELECT *, CASE WHEN NOT sounded AND by_stage > 0 AND wn >= 6 AND r2 >= 0.25 THEN 0.8 * least(1.0, sqrt(wn / 12.0)) * (0.25 + 0.75 * r2) ELSE 0.0 END AS stage_w,
        CASE WHEN wb / wm > 3 THEN 3 / (wb / wm) ELSE 1.0 END * CASE WHEN cv > 0 THEN least(1.0, 0.5 / cv) ELSE 1.0 END AS gage_w FROM j),
    d AS (SELECT *, CASE WHEN sounded THEN sd WHEN stage_w > 0 THEN (1 - stage_w) * prior_m + stage_w * least(15.0, greatest(0.5, by_stage)) ELSE prior_m END AS d1 FROM sw),
    r AS (SELECT *, CASE WHEN sounded THEN 'soundings' WHEN a IS NOT NULL THEN 'gage' WHEN stage_w > 0 THEN 'width_stage' ELSE 'prior' END AS depth_source,
        least(15.0, greatest(0.5, CASE WHEN NOT sounded AND a IS NOT NULL AND gage_w > 0 THEN (1 - gage_w) * d1 + gage_w * least(15.0, greatest(0.5, a * sqrt(width_m))) ELSE d1 END)) AS depth_raw_m FROM d),
    med AS (SELECT *, CASE WHEN count(depth_raw_m) OVER w >= 2 THEN median(depth_raw_m) OVER w END AS mid FROM r WINDOW w AS (PARTITION BY river_id ORDER BY s_center_m ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    sm AS (SELECT *, coalesce(CASE WHEN count(mid) OVER w >= 2 THEN avg(mid) OVER w END, depth_raw_m) AS depth_m FROM med WINDOW w AS (PARTITION BY river_id ORDER BY s_center_m ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    done AS (SELECT *, least(wse_m - depth_m, bank_min_m - 0.05) AS bed_m, CAST(CASE depth_source WHEN 'soundings' THEN sn WHEN 'gage' THEN gn WHEN 'width_stage' THEN wn ELSE 0 END AS BIGINT) AS calibrations,
        least(5.0, greatest(0.25, CASE depth_source WHEN 'soundings' THEN greatest(0.35, 0.9 / sqrt(sn)) WHEN 'width_stage' THEN CASE WHEN r2 < 0.85 THEN 1.2 ELSE 1 END * CASE WHEN stage_w < 0.5 THEN 1.2 ELSE 1 END
        WHEN 'gage' THEN 1.2 * CASE WHEN cv > 0.5 THEN 1.3 ELSE 1 END * (1 + greatest(0.0, 0.6 - gage_w)) ELSE 1.5 END)) AS sigma_m FROM sm)"""

#: Raw samples of sections, their banks and levels, reach attributes and priors, as tables ``smp`` to ``x``.
_RAW = """smp AS (SELECT xs_id, i * width_m / 12 AS dist_m, CASE WHEN xs_id % 4 > 0 THEN wse_m + abs(i - 12) * 0.1 + (xs_id * i % 7) * 0.01 END AS z, CASE WHEN xs_id % 8 > 0 OR i NOT BETWEEN 11 AND 13 THEN wse_m + abs(i - 12) * 0.12 END AS z2,
        i = 4 + xs_id % 2 AND xs_id % 17 > 0 AS is_left, i = 19 - xs_id % 3 AS is_right FROM fx_sections, (SELECT unnest(range(0, 25)) AS i)),
    bk AS (SELECT xs_id, max(dist_m) AS len, min(dist_m) FILTER (is_left) AS left_m, max(dist_m) FILTER (is_right) AS right_m, max(coalesce(z, z2)) FILTER (is_left) AS left_z, max(coalesce(z, z2)) FILTER (is_right) AS right_z FROM smp GROUP BY xs_id),
    lv AS (SELECT xs_id, coalesce(CASE WHEN count(z) >= 3 THEN quantile_cont(z, 0.1) END, CASE WHEN count(z2) >= 3 THEN quantile_cont(z2, 0.1) END) AS lv FROM smp JOIN bk USING (xs_id) WHERE abs(dist_m - len / 2) <= greatest(1.0, 0.05 * len) GROUP BY xs_id),
    b AS (SELECT s.xs_id, s.river_id, s.s_center_m, CASE WHEN s.xs_id % 7 <= 5 THEN s.xs_id % 30 END AS site, left_m, right_m, right_m - left_m AS width_m, least(left_z, right_z) AS bank_min_m, coalesce(lv, least(left_z, right_z) - 0.5) AS wse_m,
        CASE WHEN s.river_id % 6 < 5 THEN 50.0 + s.river_id * 13 END AS area, CASE WHEN s.river_id % 6 < 5 THEN 5e-5 + s.river_id * 1e-4 END AS slope, CASE WHEN s.river_id % 6 < 5 THEN 5.5 + s.river_id END AS mouth
        FROM fx_sections s JOIN bk USING (xs_id) LEFT JOIN lv USING (xs_id) WHERE left_m IS NOT NULL AND right_m IS NOT NULL),
    p0 AS (SELECT *, least(15.0, greatest(0.5, 0.18 * sqrt(width_m) * CASE WHEN area IS NULL THEN 1.0 ELSE pow(area + 1, 0.05) * pow(slope + 1e-4, -0.1) END)) AS d0,
        least(15.0, greatest(0.5, 0.2 * pow(area, 0.33) * 2 / 1.3)) AS curve_m, 20.0 * pow(area * 0.386102, 0.78) * 0.0283168 AS flood,
        CASE WHEN slope < 1e-4 THEN 0.2 WHEN slope < 3e-4 THEN 0.5 WHEN slope < 1e-3 THEN 0.5 + 0.5 * (slope - 3e-4) / 7e-4 ELSE 1.0 END AS guard FROM b),
    p1 AS (SELECT *, CASE WHEN area IS NOT NULL THEN 0.64 * d0 + 0.36 * curve_m ELSE d0 END AS curved,
        least(15.0, greatest(0.5, least(20.0, greatest(0.3, pow(0.035 * flood / (width_m * sqrt(slope)), 0.6))) * 2 / 1.3)) AS by_friction, CASE WHEN slope >= 1e-4 AND mouth > 10 AND 0.7 * guard >= 0.3 THEN 0.36 * 0.7 * guard ELSE 0.0 END AS fw FROM p0),
    x AS (SELECT *, CASE WHEN fw > 0 THEN (1 - fw) * curved + fw * by_friction ELSE curved END AS prior_m FROM p1)"""


def _samples(xs):
    i = C("i")
    rows = xs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(24))))
    return rows.select(
        "xs_id", (i * C("width_m") / 12).alias("dist_m"), F.when(C("xs_id") % 4 > 0, C("wse_m") + F.abs(i - 12) * 0.1 + (C("xs_id") * i % 7) * 0.01).alias("z"),
        F.when((C("xs_id") % 8 > 0) | ~i.between(11, 13), C("wse_m") + F.abs(i - 12) * 0.12).alias("z_second"),
        ((i == 4 + C("xs_id") % 2) & (C("xs_id") % 17 > 0)).alias("is_left"), (i == 19 - C("xs_id") % 3).alias("is_right"),
    )


def _inferred(xs, m):
    lines = xs.select("xs_id", "river_id", "s_center_m", (C("xs_id") % 30).cast("int").alias("site_no"), (C("xs_id") % 7 * 1000.0).alias("site_m"))
    reaches = xs.select("river_id").distinct().where("river_id % 6 < 5").select("river_id", (50.0 + C("river_id") * 13).alias("drain_area_km2"), (5e-5 + C("river_id") * 1e-4).alias("slope_mpm"), (5.5 + C("river_id")).alias("mouth_km"))
    return rivers.inferred_rivers(_samples(xs), lines, _measured(m), reaches, _sounded(xs), multivariate=True, curve="piedmont", discharge="two_year", region="piedmont")


def _measured(m):
    """Sites of which every fifth has no areas, so that only widths and stages count."""
    return m.withColumn("area_sqft", F.when(C("site_no") % 5 != 1, C("area_sqft")))


def _sounded(xs):
    return xs.where("xs_id % 9 = 0").select("xs_id", F.lit(3).cast("long").alias("n"), C("depth_pred_m").alias("median_m"))


@query(
    "p7_river_depths", "fx_sections fx_measurements", doubles="s_center_m depth_raw_m depth_m bed_m",
    twin=f"""WITH x AS (SELECT *, xs_id % 30 AS site, wse_m + 1 - xs_id % 5 AS bank_min_m, least(15.0, greatest(0.5, 0.18 * sqrt(width_m))) AS prior_m FROM fx_sections), {_CALIBRATED}
        SELECT xs_id, river_id, s_center_m, depth_source, depth_raw_m, depth_m, bed_m FROM done""",
)
def _(xs, m):
    x = xs.withColumns({"site_no": (C("xs_id") % 30).cast("int"), "bank_min_m": C("wse_m") + 1 - C("xs_id") % 5})
    return pipelines.river_depths(x, _measured(m), _sounded(xs))


@query(
    "p7_inferred_sections", "fx_sections fx_measurements", doubles="width_m wse_m prior_m friction_weight depth_raw_m depth_m sigma_m bed_m",
    twin=f"WITH {_RAW}, {_CALIBRATED} SELECT xs_id, river_id, width_m, wse_m, prior_m, fw AS friction_weight, depth_source, calibrations, depth_raw_m, depth_m, sigma_m, bed_m FROM done",
)
def _(xs, m):
    return _inferred(xs, m)[0].select("xs_id", "river_id", "width_m", "wse_m", "prior_m", "friction_weight", "depth_source", "calibrations", "depth_raw_m", "depth_m", "sigma_m", "bed_m")


@query(
    "p7_bed_points", "fx_sections fx_measurements", doubles="dist_m depth_m bed_m sigma_m",
    twin=f"""WITH {_RAW}, {_CALIBRATED}, t AS (SELECT s.xs_id, s.dist_m, s.dist_m - left_m AS l, width_m AS w, width_m * 0.35 AS side, depth_m AS dmax, wse_m, bank_min_m, sigma_m FROM smp s JOIN done USING (xs_id) WHERE s.dist_m BETWEEN left_m AND right_m),
        u AS (SELECT *, CASE WHEN l < side THEN dmax * l / side WHEN l > w - side THEN dmax * (w - l) / side ELSE dmax END AS depth FROM t)
        SELECT xs_id, dist_m, depth AS depth_m, least(wse_m - depth, bank_min_m - 0.05) AS bed_m, sigma_m FROM u""",
)
def _(xs, m):
    return _inferred(xs, m)[1]

"""Queries of masks after prediction, tie-point accuracy and shifts, and depth caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalspark.operators import alignment
from shoalspark.plans.registry import query

C = F.col
_GRID = (5e5, 3.4e6, 10.0)
_WET = "b08 < 0.09 AND b02 > 0.001 AND b03 > 0.001 AND b04 > 0.001"
_AT = "(SELECT p.point_id, p.source, abs(p.depth_m) AS z, x.v FROM fx_points p JOIN (SELECT prow, pcol, b03 * 150 AS v FROM fx_pixels) x ON x.prow = CAST(floor((3.4e6 - p.y) / 10) AS INT) AND x.pcol = CAST(floor((p.x - 5e5) / 10) AS INT))"
_ACC = "sqrt(avg(pow({p} - z, 2))) AS rmse, avg(abs({p} - z)) AS mae, avg({p} - z) AS bias, CASE WHEN var_pop(z) > 0 THEN 1 - sum(pow({p} - z, 2)) / (var_pop(z) * count(*)) END AS r2, count(*) AS n"


@query("f28_wet_pixels", "fx_pixels", twin=f"SELECT cell FROM fx_pixels WHERE {_WET}")
def _(px):
    return alignment.wet_pixels(px).select("cell")


@query("f18_bright_masked", "fx_pixels", doubles="v", twin="SELECT cell, CASE WHEN NOT (b02 > 0.08 AND b08 >= 0.03) THEN b03 * 150 END AS v FROM fx_pixels")
def _(px):
    return alignment.bright_masked(px.withColumn("v", C("b03") * 150), "v", 0.08).select("cell", "v")


@query("f15_funnel", "fx_pixels", twin="SELECT CAST(0 AS INT) AS rank, 'all' AS step, count(*) AS n FROM fx_pixels UNION ALL SELECT 1, 'water', count(*) FROM fx_pixels WHERE land = 0 UNION ALL SELECT 2, 'dark', count(*) FROM fx_pixels WHERE land = 0 AND b08 < 0.03")
def _(px):
    return alignment.funnel(px, {"water": "land = 0", "dark": "b08 < 0.03"})


@query("f27_gated_residuals", "fx_points", twin="SELECT point_id FROM fx_points WHERE abs(depth_m + 10) <= 5")
def _(p):
    return alignment.gated_residuals(p.withColumn("e", C("depth_m") + 10), "e", 5.0).select("point_id")


@query("j23_raster_accuracy", "fx_points fx_pixels", doubles="rmse mae bias r2", twin=f"SELECT source, {_ACC.format(p='v')} FROM {_AT} WHERE z <= 15 GROUP BY ROLLUP (source)")
def _(p, px):
    return alignment.raster_accuracy(p, px.withColumn("v", C("b03") * 150), "v", *_GRID, deepest=15.0)


@query("m24_aligned_report", "fx_points fx_pixels", doubles="rmse mae bias r2", twin=f"""WITH t AS (SELECT *, CASE WHEN v < 2 THEN 0 WHEN v < 5 THEN 1 WHEN v < 10 THEN 2 WHEN v < 20 THEN 3 WHEN v < 30 THEN 4 WHEN v <= 40 THEN 5 END AS bin FROM {_AT}), s AS (SELECT bin, median(v - z) AS shift FROM t WHERE bin IS NOT NULL GROUP BY bin), a AS (SELECT z, v, v - coalesce(shift, 0) AS w FROM t LEFT JOIN s USING (bin))
    SELECT 'before' AS stage, {_ACC.format(p='v')} FROM a UNION ALL SELECT 'after' AS stage, {_ACC.format(p='w')} FROM a""")
def _(p, px):
    return alignment.aligned_raster(px.withColumn("v", C("b03") * 150), p, "v", *_GRID)[1]


@query("a57_depth_cap", "fx_pixels", doubles="kd physics_m cap_m", twin=f"""WITH k AS (SELECT median(least(5.0, greatest(0.01, pow(10, -0.8813 - 2.0584 * r + 2.5878 * r * r - 3.4885 * pow(r, 3) + 1.5061 * pow(r, 4))))) AS kd, count(*) AS n FROM (SELECT log10(b02 / b03) AS r FROM fx_pixels WHERE {_WET})),
    l AS (SELECT kd, n, least(50.0, round(2.3 / kd, 1)) AS physics_m FROM k) SELECT kd, n, physics_m, least(physics_m, 18.0) AS cap_m, CASE WHEN physics_m <= 18 THEN 'light' ELSE 'error' END AS limited_by FROM l""")
def _(px):
    return alignment.depth_cap(px, rmse_cap=18.0)


@query("a44_soundings_usage", "fx_points", doubles="x_min x_max y_min y_max depth_m_min depth_m_max", twin="SELECT source, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(depth_m) AS depth_m_min, max(depth_m) AS depth_m_max FROM fx_points GROUP BY source")
def _(p):
    return alignment.soundings_usage(p)

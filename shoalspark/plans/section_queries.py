"""Queries of section levels and banks, collapsed points, training rows and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalspark.operators import modelling, profiles, sections
from shoalspark.plans.registry import query

C = F.col

_SAMPLES = "(SELECT CAST(prow AS BIGINT) AS xs_id, pcol * 10.0 AS dist_m, CASE WHEN prow % 4 > 0 THEN b03 END AS z, CASE WHEN prow % 8 > 0 THEN b04 END AS z_second, pcol % 9 = 1 AS is_left, pcol % 11 = 7 AS is_right FROM fx_pixels)"


def _samples(px):
    return px.select(C("prow").cast("long").alias("xs_id"), (C("pcol") * 10.0).alias("dist_m"), F.when(C("prow") % 4 > 0, C("b03")).alias("z"), F.when(C("prow") % 8 > 0, C("b04")).alias("z_second"), (C("pcol") % 9 == 1).alias("is_left"), (C("pcol") % 11 == 7).alias("is_right"))


@query("a40_water_levels", "fx_pixels", doubles="wse_m", twin=f"""WITH s AS (SELECT *, max(dist_m) OVER (PARTITION BY xs_id) AS len FROM {_SAMPLES}), l AS (SELECT xs_id, coalesce(CASE WHEN count(z) >= 3 THEN quantile_cont(z, 0.1) END, CASE WHEN count(z_second) >= 3 THEN quantile_cont(z_second, 0.1) END) AS lv FROM s WHERE abs(dist_m - len / 2) <= 0.05 * len GROUP BY xs_id),
    b AS (SELECT xs_id, max(dist_m) * 0.1 AS left_z, max(dist_m) * 0.2 AS right_z FROM s GROUP BY xs_id) SELECT xs_id, coalesce(lv, least(left_z, right_z) - 0.5) AS wse_m FROM b LEFT JOIN l USING (xs_id)""")
def _(px):
    banks = _samples(px).groupBy("xs_id").agg((F.max("dist_m") * 0.1).alias("left_z"), (F.max("dist_m") * 0.2).alias("right_z"))
    return sections.water_levels(_samples(px), banks)


@query("g6_bank_positions", "fx_pixels", doubles="left_m right_m width_m", twin=f"SELECT *, abs(right_m - left_m) AS width_m FROM (SELECT xs_id, min(dist_m) FILTER (is_left) AS left_m, max(dist_m) FILTER (is_right) AS right_m FROM {_SAMPLES} GROUP BY xs_id)")
def _(px):
    return sections.bank_positions(_samples(px))


@query("a7_collapsed", "fx_points", doubles="depth_m", twin="SELECT CAST(floor((3.4e6 - y) / 30) AS INT) AS prow, CAST(floor((x - 5e5) / 30) AS INT) AS pcol, median(depth_m) AS depth_m FROM fx_points GROUP BY 1, 2")
def _(p):
    return sections.collapsed(p, "depth_m", 5e5, 3.4e6, 30.0, "median")


@query("a8_thalweg", "fx_points", doubles="depth_m", twin="SELECT track, min(depth_m) AS depth_m, arg_min(point_id, struct_pack(d := depth_m, p := point_id)) AS point_id FROM fx_points GROUP BY track")
def _(p):
    return sections.thalweg(p, "track", "point_id", "depth_m")


@query("f8_sanitised", "fx_points", doubles="v", twin="SELECT point_id, depth_m / (point_id % 5) AS v FROM fx_points WHERE point_id % 5 > 0 AND sample_weight IS NOT NULL")
def _(p):
    v = F.when(C("point_id") % 5 == 0, F.lit(float("nan"))).otherwise(C("depth_m") / F.nullif(C("point_id") % 5, F.lit(0)))
    return sections.sanitised(p.withColumn("v", v), ["v", "sample_weight"]).select("point_id", "v")


@query("u6_with_survey_rows", "fx_points", twin="SELECT point_id FROM fx_points WHERE point_id % 4 > 0 OR source = 'extra_xyz'")
def _(p):
    return sections.with_survey_rows(p.withColumn("is_test", C("point_id") % 4 == 0), C("source") == "extra_xyz").select("point_id")


@query("a50_variance_summary", "fx_pixels", doubles="mean_m median_m most_m share", twin=" UNION ALL ".join(f"SELECT '{b}' AS component, avg(sqrt({b})) AS mean_m, median(sqrt({b})) AS median_m, max(sqrt({b})) AS most_m, sum({b}) / sum(b02 + b03 + b04) AS share FROM fx_pixels" for b in ("b02", "b03", "b04")))
def _(px):
    return sections.variance_summary(px, ["b02", "b03", "b04"])


@query("a12_tile_weights", "fx_scenes", doubles="weight", twin="SELECT tile, sum(cloud) / sum(sum(cloud)) OVER () AS weight FROM fx_scenes GROUP BY tile")
def _(s):
    return sections.tile_weights(s, "tile", "cloud")


@query("x39_huber_weights", "fx_points", doubles="w", twin="SELECT point_id, CASE WHEN abs(depth_m / 5) > 1 THEN 1 / abs(depth_m / 5) ELSE 1 END AS w FROM fx_points")
def _(p):
    return p.select("point_id", modelling.huber_weight(C("depth_m") / 5).alias("w"))


@query("g1_reach_graph", "fx_lines", doubles="length_m", twin="""WITH s AS (SELECT line_id, seq, x, y, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM fx_lines WINDOW w AS (PARTITION BY line_id ORDER BY seq))
    SELECT line_id AS river_id, concat(CAST(CAST(arg_min(x, seq) AS BIGINT) AS VARCHAR), ':', CAST(CAST(arg_min(y, seq) AS BIGINT) AS VARCHAR)) AS from_node, concat(CAST(CAST(arg_max(x, seq) AS BIGINT) AS VARCHAR), ':', CAST(CAST(arg_max(y, seq) AS BIGINT) AS VARCHAR)) AS to_node, sum(d) AS length_m FROM s GROUP BY line_id""")
def _(lines):
    coords = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return profiles.reach_graph(lines.groupBy(C("line_id").alias("river_id")).agg(coords.alias("coords")))[1]

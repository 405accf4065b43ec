"""Queries of regridding, surveys, residual shapes and local surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalspark.operators import surveys
from shoalspark.plans.registry import query

C = F.col


@query("j5_nearest_regrid", "fx_pixels", doubles="b03", twin="SELECT t.cell, s.b03 FROM fx_pixels t LEFT JOIN fx_pixels s ON s.prow = CAST(floor((3.4e6 - (t.y + 3)) / 10) AS INT) AND s.pcol = CAST(floor((t.x + 7 - 5e5) / 10) AS INT)")
def _(px):
    return surveys.regridded_nearest(px, px.select("cell", (C("x") + 7).alias("x"), (C("y") + 3).alias("y")), "b03", 5e5, 3.4e6, 10.0).select("cell", "b03")


@query("j6_bilinear_regrid", "fx_pixels", doubles="b03", twin="""SELECT a.cell, 0.7 * 0.6 * a.b03 + 0.7 * 0.4 * r.b03 + 0.3 * 0.6 * d.b03 + 0.3 * 0.4 * e.b03 AS b03 FROM fx_pixels a LEFT JOIN fx_pixels r ON r.prow = a.prow AND r.pcol = a.pcol + 1
    LEFT JOIN fx_pixels d ON d.prow = a.prow + 1 AND d.pcol = a.pcol LEFT JOIN fx_pixels e ON e.prow = a.prow + 1 AND e.pcol = a.pcol + 1""")
def _(px):
    return surveys.regridded_bilinear(px, px.select("cell", (C("x") + 4).alias("x"), (C("y") - 3).alias("y")), "b03", 5e5, 3.4e6, 10.0)


@query("j21_bed_minus_terrain", "fx_pixels", doubles="depth_m", twin="SELECT prow, pcol, b02 - b03 AS depth_m FROM fx_pixels")
def _(px):
    return surveys.bed_minus_terrain(px, px, "b02", "b03")


_NEAR = """SELECT * FROM (SELECT p.point_id, p.depth_m, s.sid, sqrt(pow(p.x - s.sx, 2) + pow(p.y - s.sy, 2)) AS dist, row_number() OVER (PARTITION BY p.point_id ORDER BY sqrt(pow(p.x - s.sx, 2) + pow(p.y - s.sy, 2)), s.sid) AS r
    FROM fx_points p, (SELECT scene_id AS sid, 5e5 + scene_id * 97 % 1000 AS sx, 3.4e6 - scene_id * 61 % 1500 AS sy FROM fx_scenes) s WHERE sqrt(pow(p.x - s.sx, 2) + pow(p.y - s.sy, 2)) <= 150) WHERE r = 1"""


def _stations(s):
    return s.select(C("scene_id").alias("sid"), (5e5 + C("scene_id") * 97 % 1000).alias("sx"), (3.4e6 - C("scene_id") * 61 % 1500).alias("sy"))


@query("j9_j10_j18_nearest_station", "fx_points fx_scenes", doubles="dist", twin=f"SELECT point_id, sid, dist FROM ({_NEAR})")
def _(p, s):
    return surveys.nearest_station(p.select("point_id", "x", "y"), _stations(s), "point_id", 150.0)


@query("j8_a37_section_calibration", "fx_points fx_scenes", doubles="median_m p90_m", twin=f"SELECT sid AS xs_id, count(*) AS n, median(abs(depth_m)) AS median_m, quantile_cont(abs(depth_m), 0.9) AS p90_m FROM ({_NEAR}) GROUP BY sid")
def _(p, s):
    return surveys.calibrated_sections(p, _stations(s).withColumnRenamed("sid", "xs_id"), 150.0)


@query("j17_nearest_surface", "fx_sections", doubles="filled", twin="""SELECT a.xs_id, (SELECT arg_min(b.wse_m, abs(a.s_center_m - b.s_center_m) * 1000000 + b.s_center_m) FROM fx_sections b WHERE b.river_id = a.river_id AND b.xs_id % 3 = 0) AS filled FROM fx_sections a""")
def _(xs):
    known = xs.withColumn("w", F.when(C("xs_id") % 3 == 0, C("wse_m")))
    return surveys.nearest_surface(known, ["river_id"], "s_center_m", "w").select("xs_id", "filled")


@query(
    "a24_bimodality", "fx_points", doubles="place density",
    twin="""WITH s AS (SELECT *, greatest(sd * pow(n, -2e-1), 1e-9) AS bw FROM (SELECT count(depth_m) AS n, stddev_samp(depth_m) AS sd, min(depth_m) AS lo, max(depth_m) AS hi FROM fx_points)), b AS (SELECT round_even(depth_m / (bw / 5), 0) AS b, count(*) AS k FROM fx_points, s GROUP BY 1),
    d AS (SELECT CAST(i AS INT) AS i, lo + (hi - lo) * i / 199e0 AS place, n, bw FROM s, (SELECT unnest(range(0, 200)) AS i)),
    g AS (SELECT i, any_value(place) AS place, sum(k * exp(-5e-1 * pow((place - b * bw / 5) / bw, 2))) / any_value(n * bw) / sqrt(2 * pi()) AS density FROM d, b GROUP BY i)
    SELECT i, place, density, density > coalesce(lag(density) OVER (ORDER BY i), -1) AND density > coalesce(lead(density) OVER (ORDER BY i), -1) AND density >= 1e-1 * max(density) OVER () AS peak FROM g""",
)
def _(p):
    return surveys.density_curve(p.select("depth_m"), "depth_m")


@query("a30_depth_gaps", "fx_points", twin="""WITH b AS (SELECT CAST(unnest(range(0, 30)) AS INT) AS bin), n AS (SELECT CAST(floor(abs(depth_m)) AS INT) AS bin, count(*) AS n FROM fx_points GROUP BY 1), s AS (SELECT bin, bin - row_number() OVER (ORDER BY bin) AS run FROM b LEFT JOIN n USING (bin) WHERE coalesce(n, 0) < 10)
    SELECT min(bin) AS from_m, max(bin) + 1 AS to_m FROM s GROUP BY run""")
def _(p):
    return surveys.depth_gaps(p)


@query("w16_top_up", "fx_points", twin="""WITH c AS (SELECT point_id, source FROM fx_points WHERE source = 'multibeam' AND point_id % 9 = 0) SELECT * FROM c UNION ALL SELECT * FROM (SELECT point_id, source FROM fx_points WHERE point_id NOT IN (SELECT point_id FROM c) ORDER BY point_id LIMIT (SELECT greatest(0, 400 - count(*)) FROM c))""")
def _(p):
    t = p.select("point_id", "source")
    return surveys.topped_up(t.where("source = 'multibeam' and point_id % 9 = 0"), t, 400, "point_id", ["point_id"])


@query(
    "w18_track_chunks", "fx_photons", doubles="far_m",
    twin="""SELECT granule, beam, CAST(floor(dist_m / 5e2) AS BIGINT) AS chunk, count(*) AS n, max(dist_m) AS far_m FROM (SELECT *, round(sqrt(pow((latitude - first(latitude) OVER w) * 111320e0, 2) + pow((longitude - first(longitude) OVER w) * 111320e0 * cos(radians(latitude)), 2)), 6) AS dist_m
    FROM fx_photons WINDOW w AS (PARTITION BY granule, beam ORDER BY delta_time ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY ALL""",
)
def _(ph):
    return surveys.track_chunks(ph, ["granule", "beam"], "delta_time", 500.0).groupBy("granule", "beam", "chunk").agg(F.count("*").alias("n"), F.max("dist_m").alias("far_m"))


@query("i7_kernel_surface", "fx_pixels fx_points")
def _(px, p):
    return surveys.local_kernel_surface(px, p.where("source = 'multibeam'"), "depth_m", 100.0)


@query("i7_thin_plate_surface", "fx_pixels fx_points")
def _(px, p):
    return surveys.local_kernel_surface(px, p.where("source = 'multibeam'"), "depth_m", 100.0, ridge=1.0, kernel="thin_plate")

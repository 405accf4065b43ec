"""Queries of links between sections, reaches, gages and tide stations, and of filters that widen, grow or gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalspark.operators import filters, links, profiles, quality
from shoalspark.plans.registry import query

C = F.col

_STATIONS = "SELECT scene_id AS sid, 5e5 + scene_id * 97 % 1000 AS sx, 3.4e6 - scene_id * 61 % 1500 AS sy FROM fx_scenes"
_SNAP = f"""st AS ({_STATIONS}), seg AS (SELECT line_id, x AS ax, y AS ay, lead(x) OVER w AS ex, lead(y) OVER w AS ey FROM fx_lines WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
    d AS (SELECT sid, line_id, sqrt(pow(sx - ax - t * (ex - ax), 2) + pow(sy - ay - t * (ey - ay), 2)) AS off FROM (SELECT *, greatest(0e0, least(1e0, ((sx - ax) * (ex - ax) + (sy - ay) * (ey - ay)) / (pow(ex - ax, 2) + pow(ey - ay, 2)))) AS t FROM st, seg WHERE ex IS NOT NULL)),
    b AS (SELECT sid, line_id, off FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY off, line_id) AS r FROM d) WHERE r = 1 AND off <= 60), snap AS (SELECT sid, sx, sy, line_id AS river_id, off AS snap_m FROM st LEFT JOIN b USING (sid))"""


def _snapped(s, lines):
    stations = s.select(C("scene_id").alias("sid"), (5e5 + C("scene_id") * 97 % 1000).alias("x"), (3.4e6 - C("scene_id") * 61 % 1500).alias("y"))
    return links.snapped_to_reaches(stations, lines, "sid", 60.0)


@query("j10_snapped_gages", "fx_scenes fx_lines", doubles="snap_m", twin=f"WITH {_SNAP} SELECT sid, river_id, snap_m FROM snap")
def _(s, lines):
    return _snapped(s, lines).select("sid", "river_id", "snap_m")


@query(
    "j9_gage_links", "fx_scenes fx_lines fx_sections", doubles="gage_m",
    twin=f"""WITH {_SNAP}, xs AS (SELECT xs_id, river_id % 5 AS river_id, 5e5 + xs_id * 37 % 1000 AS x, 3.4e6 - xs_id * 53 % 1500 AS y, CASE xs_id % 4 WHEN 0 THEN 'old' WHEN 1 THEN 'None' END AS had, CASE WHEN xs_id % 4 = 0 THEN xs_id % 300 * 1e0 END AS had_m FROM fx_sections),
        p AS (SELECT xs_id, sid, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS dist, CASE WHEN snap.river_id = xs.river_id THEN 0 ELSE 1 END AS other FROM xs, snap),
        n AS (SELECT xs_id, sid, dist FROM (SELECT *, row_number() OVER (PARTITION BY xs_id ORDER BY other, dist, sid) AS r FROM p) WHERE r = 1)
        SELECT xs_id, CASE WHEN had_m IS NULL OR dist < had_m THEN CAST(sid AS VARCHAR) ELSE had END AS gage_site, CASE WHEN had_m IS NULL OR dist < had_m THEN dist ELSE had_m END AS gage_m FROM xs JOIN n USING (xs_id)""",
)
def _(s, lines, xs):
    gages = _snapped(s, lines).select(C("sid").alias("site_no"), C("x").alias("sx"), C("y").alias("sy"), "river_id")
    at = xs.select("xs_id", (C("river_id") % 5).alias("river_id"), (5e5 + C("xs_id") * 37 % 1000).alias("x"), (3.4e6 - C("xs_id") * 53 % 1500).alias("y"))
    had = at.withColumn("gage_site", F.when(C("xs_id") % 4 == 0, "old").when(C("xs_id") % 4 == 1, "None")).withColumn("gage_m", F.when(C("xs_id") % 4 == 0, C("xs_id") % 300 * 1.0))
    return links.gage_links(had, gages, 100.0).select("xs_id", "gage_site", "gage_m")


@query(
    "j18_tide_at", "fx_points fx_scenes fx_measurements", doubles="dist nearest_at nearest_value",
    twin="""WITH p AS (SELECT point_id, -1.32e2 + point_id * 37 % 7500 * 1e-2 AS lon, 2.3e1 + point_id * 53 % 2800 * 1e-2 AS lat, CAST(point_id * 997 % 2000000 AS DOUBLE) AS moment FROM fx_points), s AS (SELECT scene_id AS sid, -1.3e2 + scene_id * 97 % 70 AS sx, 2.4e1 + scene_id * 61 % 26 AS sy FROM fx_scenes),
        d AS (SELECT point_id, moment, sid, sqrt(pow(lon - sx, 2) + pow(lat - sy, 2)) AS dist FROM p, s WHERE lon > -130 AND lon < -60 AND lat > 24 AND lat < 50),
        n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, sid) AS r FROM d) WHERE r = 1 AND dist < 3), t AS (SELECT site_no + 1 AS sid, meas_id * 3.6e3 AS hour_at, stage_ft AS tide FROM fx_measurements),
        h AS (SELECT point_id, t.hour_at AS nearest_at, tide AS nearest_value, row_number() OVER (PARTITION BY point_id ORDER BY abs(t.hour_at - n.moment), t.hour_at) AS r FROM n JOIN t USING (sid))
        SELECT p.point_id, n.sid, n.dist, h.nearest_at, h.nearest_value FROM p LEFT JOIN n USING (point_id) LEFT JOIN h ON h.point_id = p.point_id AND h.r = 1""",
)
def _(p, s, m):
    requests = p.select("point_id", (-132.0 + C("point_id") * 37 % 7500 * 0.01).alias("longitude"), (23.0 + C("point_id") * 53 % 2800 * 0.01).alias("latitude"), (C("point_id") * 997 % 2_000_000).cast("double").alias("at"))
    stations = s.select(C("scene_id").alias("sid"), (-130.0 + C("scene_id") * 97 % 70).alias("sx"), (24.0 + C("scene_id") * 61 % 26).alias("sy"))
    tides = m.select((C("site_no") + 1).cast("long").alias("sid"), (C("meas_id") * 3600.0).alias("at"), C("stage_ft").alias("tide"))
    return links.tide_at(requests, stations, tides, "point_id").select("point_id", "sid", "dist", "nearest_at", "nearest_value")


_BOX = (-87.989, -87.979, 30.49, 30.5)


@query("f1_relaxed_area", "fx_points", twin="SELECT point_id FROM fx_points WHERE longitude BETWEEN -87.994 AND -87.974 AND latitude BETWEEN 30.485 AND 30.505 AND ((longitude BETWEEN -87.989 AND -87.979 AND latitude BETWEEN 30.49 AND 30.5) OR NOT EXISTS (SELECT 1 FROM fx_points WHERE longitude BETWEEN -87.989 AND -87.979 AND latitude BETWEEN 30.49 AND 30.5))")
def _(p):
    # one nanodegree inward, as the widened edges aren't exact and points lie on them
    west, east, south, north = _BOX
    return links.in_area(p.withColumns({"longitude": F.round("longitude", 7), "latitude": F.round("latitude", 7)}), (west, east, south, north), 0.5 + 1e-6).select("point_id")


@query(
    "l1_dates_of_months", "fx_scenes", doubles="score",
    twin="""WITH s AS (SELECT tile, cloud, DATE '2021-01-01' + day_no * 13 AS d FROM fx_scenes), b AS (SELECT d, tile, min(cloud) AS cloud, CASE tile WHEN 'T0' THEN 0.5 WHEN 'T1' THEN 0.3 ELSE 0 END AS w FROM s WHERE month(d) IN (3, 4, 5, 6, 7) GROUP BY d, tile)
        SELECT strftime(d, '%Y-%m-%d') AS day, CASE WHEN sum(w) > 0 THEN sum(cloud * w) / sum(w) ELSE 100 END AS score, count(*) AS tiles FROM b GROUP BY d ORDER BY round(CASE WHEN sum(w) > 0 THEN sum(cloud * w) / sum(w) ELSE 100 END, 6), d LIMIT 5""",
)
def _(s):
    dated = s.withColumn("date", F.date_add(F.lit("2021-01-01").cast("date"), C("day_no") * 13))
    weights = F.when(C("tile") == "T0", 0.5).when(C("tile") == "T1", 0.3)
    return links.ranked_dates(dated, weights, (3, 4, 5, 6, 7), n=5).select(F.date_format("date", "yyyy-MM-dd").alias("day"), "score", "tiles")


@query(
    "f9_scene_validity", "fx_pixels",
    twin="""WITH bad AS (SELECT prow, pcol FROM fx_pixels WHERE scl IN (0, 3, 8, 9, 10, 11)), near AS (SELECT DISTINCT prow + i AS prow, pcol + j AS pcol FROM bad, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(i, j))
        SELECT cell, near.prow IS NULL AS valid FROM fx_pixels LEFT JOIN near USING (prow, pcol)""",
)
def _(px):
    return filters.scene_validity(px).select("cell", "valid")


@query(
    "w6_gated_slope", "fx_sections", doubles="slope",
    twin="""WITH m AS (SELECT xs_id, river_id, s_center_m AS s, median(wse_m) OVER (PARTITION BY river_id ORDER BY s_center_m ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM fx_sections),
        g AS (SELECT river_id, count(*) >= 10 AND abs(corr(s, v)) >= 0.7 AS ok FROM m GROUP BY river_id), n AS (SELECT *, s - lag(s) OVER w AS h0, lead(s) OVER w - s AS h1, (v - lag(v) OVER w) / (s - lag(s) OVER w) AS r0, (lead(v) OVER w - v) / (lead(s) OVER w - s) AS r1 FROM m WINDOW w AS (PARTITION BY river_id ORDER BY s))
        SELECT xs_id, CASE WHEN ok THEN least(5e-2, abs(CASE WHEN h0 IS NULL THEN r1 WHEN h1 IS NULL THEN r0 ELSE (r0 * h1 + r1 * h0) / (h0 + h1) END)) END AS slope FROM n JOIN g USING (river_id)""",
)
def _(xs):
    return profiles.gated_slope(xs, "river_id", "s_center_m", "wse_m").select("xs_id", "slope")


@query(
    "q5_run_messages", "fx_scenes",
    twin="""WITH r AS (SELECT scene_id, scene_id % 6 AS k, DATE '2015-06-20' + day_no AS a, cloud - 5 AS far FROM fx_scenes), d AS (SELECT *, CASE k WHEN 1 THEN a - 1 WHEN 2 THEN a WHEN 3 THEN a + 1200 ELSE a + 90 END AS b FROM r),
        m AS (SELECT scene_id, CASE WHEN k = 0 THEN ['error: start isn''t a date'] WHEN k = 1 THEN ['error: end is before start'] ELSE list_filter([CASE WHEN k = 2 THEN 'warning: a single day' WHEN k = 3 THEN 'warning: longer than three years' END, CASE WHEN a > DATE '2015-07-01' THEN 'warning: start is to come' END, CASE WHEN b > DATE '2015-07-01' THEN 'warning: end is to come' END, CASE WHEN a < DATE '2015-06-23' THEN 'warning: start is before the first scenes' END], lambda v: v IS NOT NULL) END AS x,
            list_filter([CASE WHEN k = 4 THEN 'error: depth limit isn''t a number or auto' WHEN k = 5 THEN NULL WHEN far <= 0 THEN 'error: depth limit isn''t positive' WHEN far > 50 THEN 'error: depth limit is beyond what light reaches' WHEN far > 25 THEN 'warning: depth limit is deep' END,
                CASE WHEN k = 2 THEN 'warning: aimed error is strict' WHEN k = 3 THEN 'warning: aimed error is lax' END, CASE WHEN k = 1 THEN 'error: bin isn''t positive' WHEN k = 2 THEN 'warning: bin is narrow' WHEN k = 3 THEN 'warning: bin is wide' END], lambda v: v IS NOT NULL) AS z FROM d)
        SELECT scene_id, array_to_string(x, '; ') AS dates, array_to_string(z, '; ') AS depths FROM m""",
)
def _(s):
    k, a = C("scene_id") % 6, F.date_add(F.lit("2015-06-20").cast("date"), C("day_no"))
    b = F.when(k == 1, F.date_sub(a, 1)).when(k == 2, a).when(k == 3, F.date_add(a, 1200)).otherwise(F.date_add(a, 90))
    start = F.when(k == 0, F.date_format(a, "dd.MM.yyyy")).otherwise(a.cast("string"))
    dates = quality.date_messages(start, b.cast("string"), F.lit("2015-07-01").cast("date"))
    far = F.when(k == 4, "deep").when(k == 5, " Auto").otherwise((C("cloud") - 5).cast("string"))
    by_kind = lambda *v: F.get(F.array(*(F.lit(x).cast("double") for x in v)), k.cast("int"))
    depths = quality.depth_messages(far, by_kind(None, 0.5, 0.05, 4, 1, 1), by_kind(None, 0, 0.1, 6, 1, 0.5))
    return s.select("scene_id", F.array_join(dates, "; ").alias("dates"), F.array_join(depths, "; ").alias("depths"))

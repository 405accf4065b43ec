"""Queries of scans, scene rows, flowlines, names, masks, sanity checks and whole fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalspark.functions import optics
from shoalspark.operators import filters, ingest, joins, modelling, pixels, points, quality
from shoalspark.plans.registry import query

C = F.col
BOX = (-87.99, -87.9, 30.5, 30.9)  # west, east, south, north of the photon queries

_RAW = "(SELECT granule, CAST(substr(beam, 3, 1) AS INT) AS laser, granule % 3 AS orient, latitude, longitude, CASE WHEN granule = 7 AND conf = 2 THEN NULL ELSE photon_height END AS photon_height, conf, delta_time FROM fx_photons)"


def _raw(ph):
    height = F.when(~((C("granule") == 7) & (C("conf") == 2)), C("photon_height"))
    return ph.select("granule", F.substring("beam", 3, 1).cast("int").alias("laser"), (C("granule") % 3).alias("orient"), "latitude", "longitude", height.alias("photon_height"), "conf", "delta_time")


@query(
    "s1_f3_photon_scan", "fx_photons", doubles="lat lon height",
    twin=f"""SELECT granule, beam, count(*) AS n, avg(latitude) AS lat, avg(longitude) AS lon, avg(photon_height) AS height FROM (SELECT *, concat('gt', laser, CASE orient WHEN 1 THEN 'r' ELSE 'l' END) AS beam FROM {_RAW}
        WHERE photon_height IS NOT NULL AND conf >= 2 AND longitude BETWEEN -87.99e0 AND -87.9e0 AND latitude BETWEEN 30.5e0 AND 30.9e0) GROUP BY granule, beam""",
)
def _(ph):
    kept = ingest.photon_scan(_raw(ph), BOX, 2)
    return kept.groupBy("granule", "beam").agg(F.count(F.lit(1)).alias("n"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.avg("photon_height").alias("height"))


@query(
    "s2_classified_scan", "fx_photons", doubles="depth_m least_m",
    twin="""SELECT granule, count(*) AS n, avg(d) AS depth_m, min(d) AS least_m FROM (SELECT granule, -abs(5e-2 - photon_height) AS d FROM fx_photons WHERE conf * 10 = 40 AND (granule % 4) * 0.25e0 >= 0.25e0) GROUP BY granule""",
)
def _(ph):
    raw = ph.select("granule", C("latitude").alias("lat_ph"), C("longitude").alias("lon_ph"), C("photon_height").alias("ortho_h"), F.lit(0.05).alias("surface_h"), (C("conf") * 10).alias("class_ph"), (C("granule") % 4 * 0.25).alias("confidence"), "delta_time")
    return ingest.classified_scan(raw, 0.25).groupBy("granule").agg(F.count(F.lit(1)).alias("n"), F.avg("depth_m").alias("depth_m"), F.min("depth_m").alias("least_m"))


@query("s24_classified_product", "fx_photons")
def _(ph):
    return ingest.classified_product(ph, 5e-3, 0.25)


@query(
    "f4_quality_picks", "fx_photons", doubles="depth_m frac_bottom",
    twin="""SELECT granule, beam, conf, depth_m, n_bottom, frac_bottom FROM (SELECT *, n_bottom / (sum(n_bottom) OVER (PARTITION BY granule, beam)) AS frac_bottom FROM (
        SELECT granule, beam, conf, avg(photon_height) * 1.5e0 AS depth_m, count(*) AS n_bottom FROM fx_photons GROUP BY ALL)) WHERE depth_m BETWEEN -40 AND -0.5 AND n_bottom >= 3 AND frac_bottom >= 0.2""",
)
def _(ph):
    picks = ph.groupBy("granule", "beam", "conf").agg((F.avg("photon_height") * 1.5).alias("depth_m"), F.count(F.lit(1)).alias("n_bottom"))
    total = picks.groupBy("granule", "beam").agg(F.sum("n_bottom").alias("total"))
    picks = picks.join(total, ["granule", "beam"]).withColumn("frac_bottom", C("n_bottom") / C("total")).drop("total")
    return ingest.quality_picks(picks, least_share=0.2)


@query(
    "s23_track_lines", "fx_photons", doubles="x0 y0 x1 y1",
    twin="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY granule, beam ORDER BY delta_time, photon_height, conf) - 1 AS k FROM fx_photons), s AS (SELECT * FROM r WHERE k % 100 = 0 AND longitude BETWEEN -87.99e0 AND -87.9e0 AND latitude BETWEEN 30.5e0 AND 30.9e0)
        SELECT granule, beam, count(*) AS n, arg_min(longitude, k) AS x0, arg_min(latitude, k) AS y0, arg_max(longitude, k) AS x1, arg_max(latitude, k) AS y1 FROM s GROUP BY granule, beam HAVING count(*) > 1""",
)
def _(ph):
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    return ingest.track_lines(ph, BOX).select("granule", "beam", F.size("coords").cast("long").alias("n"), first["x"].alias("x0"), first["y"].alias("y0"), last["x"].alias("x1"), last["y"].alias("y1"))


_ITEMS = "(SELECT scene_id, CASE WHEN scene_id % 7 > 0 THEN day_no END AS dt, cloud, CASE WHEN scene_id % 5 > 0 THEN 'g' END AS geometry, CASE WHEN scene_id % 3 > 0 THEN tile ELSE 'UNK' END AS tile FROM fx_scenes)"


@query(
    "s10_scene_rows", "fx_scenes",
    twin=f"SELECT CASE WHEN dt IS NULL THEN 'no_datetime' WHEN cloud > 40 THEN 'cloudy' WHEN geometry IS NULL THEN 'no_geometry' WHEN tile = 'UNK' THEN 'no_tile' ELSE 'kept' END AS reason, count(*) AS n FROM {_ITEMS} GROUP BY 1",
)
def _(sc):
    items = sc.select("scene_id", F.when(C("scene_id") % 7 > 0, C("day_no")).alias("dt"), "cloud", F.when(C("scene_id") % 5 > 0, F.lit("g")).alias("geometry"), F.when(C("scene_id") % 3 > 0, C("tile")).otherwise("UNK").alias("tile"))
    return ingest.drop_counts(ingest.scene_rows(items, 40.0))


@query(
    "f2_areas", "fx_scenes", doubles="west east south north",
    twin="""SELECT scene_id, CASE WHEN scene_id % 9 > 0 THEN w - (e - w) * 5e-2 END AS west, CASE WHEN scene_id % 9 > 0 THEN e + (e - w) * 5e-2 END AS east, CASE WHEN scene_id % 9 > 0 THEN s - (n - s) * 5e-2 END AS south,
        CASE WHEN scene_id % 9 > 0 THEN n + (n - s) * 5e-2 END AS north FROM (SELECT scene_id, -(scene_id % 90)::DOUBLE AS w, -(scene_id % 90) + (day_no + 1)::DOUBLE AS e, (scene_id % 60)::DOUBLE AS s, (scene_id % 60 + 2)::DOUBLE AS n FROM fx_scenes)""",
)
def _(sc):
    number = lambda c: c.cast("string")
    k = C("scene_id")
    text = F.concat_ws("/", number(-(k % 90)), number(-(k % 90) + C("day_no") + 1), number(k % 60), F.when(k % 9 > 0, number(k % 60 + 2)))
    return sc.select("scene_id", *(v.alias(n) for n, v in ingest.parsed_area(text, 0.05).items()))


@query(
    "s25_target_grid", "fx_points", doubles="origin_x origin_y cell_w cell_h",
    twin="""SELECT x0 AS origin_x, y1 AS origin_y, nc AS columns, nr AS rows, (x1 - x0) / nc AS cell_w, (y1 - y0) / nr AS cell_h FROM (SELECT *, greatest(1, ceil((x1 - x0) / 7e0))::INT AS nc, greatest(1, ceil((y1 - y0) / 7e0))::INT AS nr
        FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fx_points))""",
)
def _(p):
    return ingest.target_grid(p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")), 7.0)


LINE_BOX = (500150.0, 500650.0, 3.4e6 - 2500.0, 3.4e6 - 210.0)
_SEGMENTS = """(SELECT line_id AS river_id, x AS ax, y AS ay, lead(x) OVER w AS ex, lead(y) OVER w AS ey FROM fx_lines WINDOW w AS (PARTITION BY line_id ORDER BY seq))"""
_CLIPPED = f"""(SELECT *, greatest(0e0, tx0, ty0) AS t0, least(1e0, tx1, ty1) AS t1 FROM (SELECT *, CASE WHEN ex = ax THEN CASE WHEN ax BETWEEN 500150 AND 500650 THEN 0e0 ELSE 2e0 END ELSE least((500150e0 - ax) / (ex - ax), (500650e0 - ax) / (ex - ax)) END AS tx0,
    CASE WHEN ex = ax THEN 1e0 ELSE greatest((500150e0 - ax) / (ex - ax), (500650e0 - ax) / (ex - ax)) END AS tx1,
    CASE WHEN ey = ay THEN CASE WHEN ay BETWEEN 3397500 AND 3399790 THEN 0e0 ELSE 2e0 END ELSE least((3397500e0 - ay) / (ey - ay), (3399790e0 - ay) / (ey - ay)) END AS ty0,
    CASE WHEN ey = ay THEN 1e0 ELSE greatest((3397500e0 - ay) / (ey - ay), (3399790e0 - ay) / (ey - ay)) END AS ty1 FROM {_SEGMENTS} WHERE ex IS NOT NULL AND (ax <> ex OR ay <> ey)))"""


def _lines(ln):
    coords = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return ln.groupBy(C("line_id").alias("river_id")).agg(coords.alias("coords"))


@query("s14_clipped_lines", "fx_lines", doubles="length_m", twin=f"SELECT river_id, sum((t1 - t0) * sqrt(pow(ex - ax, 2) + pow(ey - ay, 2))) AS length_m, count(*) AS pieces FROM {_CLIPPED} WHERE t0 < t1 GROUP BY river_id")
def _(ln):
    return ingest.clipped_lines(_lines(ln), LINE_BOX).drop("parts")


@query(
    "s13_flowlines", "fx_lines", doubles="length_m",
    twin=f"""SELECT CASE WHEN river_id % 3 = 0 THEN concat('R', river_id) WHEN river_id % 3 = 1 THEN concat('H', river_id) ELSE concat('reach_', river_id) END AS river_id, length_m FROM (
        SELECT river_id, sum(sqrt(pow(ex - ax, 2) + pow(ey - ay, 2))) AS length_m, bool_or(t0 < t1) AS meets FROM {_CLIPPED} GROUP BY river_id) WHERE meets""",
)
def _(ln):
    k = C("river_id")
    raw = _lines(ln).select(k.alias("row"), F.when(k % 3 == 0, F.concat(F.lit("R"), k)).otherwise(" ").alias("permanent"), F.when(k % 3 == 1, F.concat(F.lit("H"), k)).alias("other"), "coords")
    return ingest.ingested_flowlines(raw, LINE_BOX, ["permanent", "other"]).select("river_id", "length_m")


@query(
    "f23_centrelines", "fx_edges",
    twin="SELECT edge_id FROM fx_edges WHERE edge_id % 3 IN (0, 1) AND edge_id % 5 > 0 AND edge_id % 7 >= 3 AND length_m / 1e3 >= 0.11",
)
def _(e):
    k = C("edge_id")
    rivers = e.select("edge_id", F.element_at(F.array(F.lit(460), F.lit(558), F.lit(336)), (k % 3 + 1).cast("int")).alias("ftype"), F.when(k % 5 > 0, k % 7).alias("stream_order"), (C("length_m") / 1e3).alias("length_km"))
    return ingest.centrelines(rivers, artificial=True, least_km=0.11).select("edge_id")


@query(
    "f26_u3_tie_points", "fx_points",
    twin="SELECT point_id, CASE source WHEN 'atl03' THEN 'atl03' WHEN 'atl24' THEN 'atl24' ELSE 'xyz' END AS tie_source, CASE source WHEN 'atl03' THEN 1 WHEN 'atl24' THEN 2 ELSE 0 END AS stack FROM fx_points WHERE source <> 'bathy_lidar'",
)
def _(p):
    return ingest.stacked_tie_points(p.withColumn("source", F.concat(F.lit(" "), F.upper("source")))).select("point_id", "tie_source", "stack")


@query("u5_first_by", "fx_points", doubles="depth_m", twin="SELECT track, min(point_id) AS point_id, arg_min(depth_m, point_id) AS depth_m FROM fx_points GROUP BY track")
def _(p):
    return ingest.first_by(p.select("track", "point_id", "depth_m"), ["track"], "point_id")


@query("l7_ordered_sections", "fx_sections", twin="SELECT xs_id, row_number() OVER (PARTITION BY river_id ORDER BY width_m, xs_id) AS place FROM fx_sections")
def _(xs):
    return ingest.ordered_sections(xs, "river_id", "width_m").select("xs_id", C("place").cast("long").alias("place"))


@query(
    "x37_band_map", "fx_scenes", doubles="b02 b03 b04 b08 cap_m",
    twin="SELECT scene_id, cloud * 1e-3 AS b02, cloud * 2e-3 AS b03, 0e0 AS b04, sun_zenith * 1e-3 AS b08, CASE WHEN scene_id % 2 = 0 THEN cloud * 1e-3 ELSE 2.5e1 END AS cap_m FROM fx_scenes",
)
def _(sc):
    named = F.create_map(F.lit("b2"), C("cloud") * 1e-3, F.lit(" Green "), C("cloud") * 2e-3, F.lit("NIR"), C("sun_zenith") * 1e-3, F.lit("swir"), F.lit(9.0))
    cap = F.when(C("scene_id") % 2 == 0, F.create_map(F.lit("max_depth"), C("cloud") * 1e-3)).otherwise(F.create_map(F.lit("other"), F.lit(1.0)))
    m = sc.withColumn("m", ingest.band_map(named))
    return m.select("scene_id", *(C("m")[b].alias(b.lower()) for b in ("B02", "B03", "B04", "B08")), ingest.first_of(cap, ("max_depth_m", "max_depth"), 25.0).alias("cap_m"))


# -- masks and filters

_AT = "(SELECT t.*, p.land, p.b04, p.scl, p.b02, p.b03 FROM fx_points t LEFT JOIN fx_pixels p ON p.prow = CAST(floor((3.4e6 - t.y) / 1e1) AS INT) AND p.pcol = CAST(floor((t.x - 5e5) / 1e1) AS INT))"


def _at(p, px, column, name):
    return filters.value_at(p, px, column, 5e5, 3.4e6, 10.0, name)


@query(
    "f5_mask_filter", "fx_points fx_pixels",
    twin=f"""WITH a AS (SELECT * FROM {_AT}), w AS (SELECT CASE WHEN count(*) FILTER (land = 0) >= count(*) FILTER (land = 1) THEN 0 ELSE 1 END AS v FROM a)
        SELECT 'binary' AS mode, point_id FROM a, w WHERE land = v UNION ALL SELECT 'probability', point_id FROM a WHERE b04 * 1e1 <= 5e-1 UNION ALL SELECT 'classes', point_id FROM a WHERE scl = 6
        UNION ALL SELECT 'inverted', point_id FROM a WHERE scl <> 6 UNION ALL SELECT 'rescued', point_id FROM a WHERE land <= 0.5""",
)
def _(p, px):
    keep = lambda mode, df, **how: filters.mask_filtered(df, **how).select(F.lit(mode).alias("mode"), "point_id")
    land, share, classes = _at(p, px, "land", "mask"), _at(p, px.withColumn("v", C("b04") * 10), "v", "mask"), _at(p, px, "scl", "mask")
    out = keep("binary", land).unionByName(keep("probability", share)).unionByName(keep("classes", classes, water=6.0)).unionByName(keep("inverted", classes, water=6.0, invert=True))
    return out.unionByName(keep("rescued", land, kind="water_only", water=4.0))


@query(
    "f6_environment_filter", "fx_points fx_pixels",
    twin=f"""WITH a AS (SELECT *, CASE WHEN scl IN (5, 6, 7) THEN 1 ELSE 0 END AS clear FROM {_AT}), w AS (SELECT CASE WHEN count(*) FILTER (land = 0) >= count(*) FILTER (land = 1) THEN 0 ELSE 1 END AS v FROM a)
        SELECT point_id FROM a, w WHERE source = 'extra_xyz' OR ((land IS NULL OR land = v) AND clear = 1)""",
)
def _(p, px):
    t = _at(_at(p, px, "land", "land"), px, "scl", "scl").withColumn("clear_water", F.when(C("scl").isin(5, 6, 7), 1.0).otherwise(0.0))
    return filters.environment_filtered(t).select("point_id")


@query("f7_brightness_caps", "fx_pixels", twin="SELECT cell FROM fx_pixels WHERE b02 <= 0.07 AND (b02 + b03 + b04) / 3 <= 0.0601")
def _(px):
    return filters.brightness_capped(px, 0.07, 0.0601).select("cell")


@query(
    "f14_coast_water", "fx_pixels",
    twin="""SELECT cell, land = 0 AND cell NOT IN (SELECT p.cell FROM fx_pixels p, (SELECT i, j FROM range(-1, 2) a(i), range(-1, 2) b(j) WHERE abs(i) + abs(j) <= 1) o JOIN fx_pixels q ON q.prow = p.prow + o.i AND q.pcol = p.pcol + o.j WHERE q.land = 1) AS water FROM fx_pixels""",
)
def _(px):
    return filters.coast_water(px, "land", erode=1).select("cell", "water")


@query("n6_channel_cells", "fx_pixels", twin="SELECT cell, coalesce(CASE WHEN scl > 0 THEN scl <> 6 END, false) AND pcol BETWEEN 20 AND 59 AS in_channel FROM fx_pixels")
def _(px):
    known = px.withColumn("m", F.when(C("scl") > 0, C("scl")))
    return filters.channel_cells(known, "m", 6, True, px.where(C("pcol").between(20, 59))).select("cell", "in_channel")


@query("f19_footprint_colours", "fx_pixels", doubles="b02 b03", twin="SELECT cell, CASE WHEN scl > 3 THEN b02 ELSE 0 END AS b02, CASE WHEN scl > 3 THEN b03 ELSE 0 END AS b03 FROM fx_pixels")
def _(px):
    predicted = px.select("prow", "pcol", F.when(C("scl") > 3, C("b04")).alias("depth"))
    return filters.footprint_colours(px, predicted, ["b02", "b03"]).select("cell", "b02", "b03")


@query("f20_strict_water", "fx_pixels", doubles="depth", twin="SELECT cell, CASE WHEN land = 0 THEN b02 END AS depth FROM fx_pixels")
def _(px):
    return filters.strict_water(px.withColumn("depth", C("b02")), "depth", "land").select("cell", "depth")


@query("f21_clipped_patch", "fx_pixels", doubles="patch", twin="SELECT cell, CASE WHEN land = 1 THEN b03 END AS patch, CASE WHEN land = 1 THEN scl ELSE 0 END AS patch_mask FROM fx_pixels")
def _(px):
    return filters.clipped_patch(px.withColumns({"patch": C("b03"), "patch_mask": C("scl")}), "patch", "patch_mask", "land").select("cell", "patch", "patch_mask")


@query("f22_without_land", "fx_pixels", doubles="depth", twin="SELECT cell, CASE WHEN land <> 1 AND scl > 2 THEN b04 END AS depth FROM fx_pixels")
def _(px):
    return filters.without_land(px.withColumn("depth", F.when(C("scl") > 2, C("b04")).otherwise(F.lit(float("nan")))), "depth", "land").select("cell", "depth")


@query(
    "f24_guarded_measurements", "fx_measurements fx_sections", doubles="width_m top_width_m",
    twin="""WITH t AS (SELECT xs_id % 20 AS site_no, median(width_m) AS top_width_m FROM fx_sections WHERE xs_id * 13 % 3000 <= 2000 GROUP BY 1 HAVING count(*) >= 3),
        r AS (SELECT m.meas_id, m.site_no, m.width_ft * 2.2 AS width_m, top_width_m FROM fx_measurements m JOIN t USING (site_no) WHERE m.width_ft * 2.2 <= 1.15 * top_width_m)
        SELECT meas_id, site_no, width_m, top_width_m, n_used FROM r JOIN (SELECT site_no, count(*) AS n_used FROM r GROUP BY 1 HAVING count(*) >= 6) USING (site_no)""",
)
def _(m, xs):
    near = xs.select((C("xs_id") % 20).cast("int").alias("site_no"), (C("xs_id") * 13 % 3000).alias("gage_dist_m"), "width_m")
    return filters.guarded_measurements(m.select("meas_id", "site_no", (C("width_ft") * 2.2).alias("width_m")), near).select("meas_id", "site_no", "width_m", "top_width_m", "n_used")


# -- models, sanity, fusion


@query(
    "a34_cluster_quality", "fx_points", doubles="compactness silhouette separation",
    twin="""WITH p AS (SELECT point_id, track % 5 AS c, x + (track % 5) * 4e2 AS x, y FROM fx_points), m AS (SELECT c, avg(x) AS cx, avg(y) AS cy, count(*) AS k, var_pop(x) + var_pop(y) AS s FROM p GROUP BY c),
        d AS (SELECT point_id, p.c AS own, m.c AS c, k, pow(x - cx, 2) + pow(y - cy, 2) AS d2, s FROM p, m), r AS (SELECT point_id, own, max(CASE WHEN c = own AND k > 1 THEN (d2 + s) * k / (k - 1) END) AS a, min(CASE WHEN c <> own THEN d2 + s END) AS b,
        max(CASE WHEN c = own THEN sqrt(d2) END) AS e FROM d GROUP BY 1, 2), g AS (SELECT own, avg(e) AS e, sum((b - a) / greatest(a, b)) AS sil, count(*) AS n FROM r GROUP BY own)
        SELECT avg(e) AS compactness, sum(sil) / sum(n) AS silhouette, (SELECT min(sqrt(pow(u.cx - v.cx, 2) + pow(u.cy - v.cy, 2))) FROM m u JOIN m v ON u.c < v.c) AS separation FROM g""",
)
def _(p):
    return modelling.cluster_quality(p.select((C("track") % 5).alias("cluster"), (C("x") + C("track") % 5 * 400.0).alias("x"), "y"))


@query(
    "a51_prediction_sanity", "fx_points", doubles="zero_share negative_share positive_share std_m mean_m least_m most_m",
    twin="""SELECT count(*) AS n_total, count(d) AS n_finite, count(*) FILTER (d = 0) / count(d) AS zero_share, count(*) FILTER (d < 0) / count(d) AS negative_share, count(*) FILTER (d > 0) / count(d) AS positive_share, stddev_pop(d) AS std_m,
        avg(d) AS mean_m, min(d) AS least_m, max(d) AS most_m, 'ok' AS status, 'mostly zero; beyond the trained range' AS messages FROM (SELECT CASE WHEN point_id % 10 = 0 THEN NULL WHEN point_id % 10 < 7 THEN 0e0 ELSE depth_m END AS d FROM fx_points)""",
)
def _(p):
    k = C("point_id") % 10
    return quality.prediction_sanity(p.select(F.when(k == 0, F.lit(float("nan"))).when(k < 7, 0.0).otherwise(C("depth_m")).alias("d")), "d", (-12.0, -1.0))


@query(
    "q2_q3_e3_checks", "fx_points", doubles="value",
    twin="""SELECT 'extra_xyz_validated' AS "check", count(*) > 0 AS passed, count(*)::DOUBLE AS value, 'ok' AS message, true AS critical FROM fx_points WHERE source = 'extra_xyz'
        UNION ALL SELECT 'sampling_reduced', true, count(DISTINCT (floor(x / 5e1), floor(y / 5e1))) / count(*), 'ok', false FROM fx_points
        UNION ALL SELECT 'not_too_deep', false, min(depth_m), 'deeper than 15 m', true FROM fx_points""",
)
def _(p):
    by_source = p.groupBy("source").agg(*modelling.accuracy(C("depth_m"), C("depth_m") * 0.9))
    own = quality.check(p, "not_too_deep", F.min("depth_m"), lambda v: v > -15, "deeper than 15 m")  # a user's check joins the suite like any other
    return quality.Suite().add(quality.validated(by_source, "extra_xyz")).add(quality.fewer_rows(p, points.thinned(p, 50.0))).add(own).run()


@query(
    "a45_river_summary", "fx_edges fx_sections", doubles="value",
    twin="""SELECT 'network' AS step, unnest(['segments', 'length_km', 'with_order', 'most_order']) AS statistic, unnest([count(*)::DOUBLE, sum(length_m) / 1e3, count(*) FILTER (edge_id % 4 > 0)::DOUBLE, max(edge_id % 4)::DOUBLE]) AS value FROM fx_edges
        UNION ALL SELECT 'sections', unnest(['sections', 'mean_width_m', 'most_width_m']), unnest([count(*)::DOUBLE, avg(width_m)::DOUBLE, max(width_m)::DOUBLE]) FROM fx_sections
        UNION ALL SELECT 'inference', unnest(['valid', 'mean_depth_m', 'most_depth_m']), unnest([count(*)::DOUBLE, avg(depth_pred_m), max(depth_pred_m)]) FROM fx_sections WHERE xs_id % 6 > 0""",
)
def _(e, xs):
    return quality.river_summary(e.withColumn("stream_order", C("edge_id") % 4), xs, xs.select(F.when(C("xs_id") % 6 > 0, C("depth_pred_m")).alias("depth_m")))


@query(
    "x22_physics_blend", "fx_pixels", doubles="depth_m sigma_m weight",
    twin="""SELECT cell, z AS depth_m, sqrt((1 - w) * (1 - w) * o * o + w * w * u * u) + 1e-1 * greatest(z - 1e1, 0e0) AS sigma_m, w AS weight FROM (SELECT *, (1 - w) * f + w * p AS z, greatest(s, 1e-1) AS o FROM (
        SELECT *, CASE WHEN p > f THEN greatest(least(1e0, greatest(0e0, (f - 8e0) / (1e1 - 8e0 + 1e-1))), 5e-1 * least(1e0, greatest(0e0, s / 3e-1))) ELSE 0e0 END AS w FROM (
        SELECT cell, b03 * 1.1e2 AS f, b04 * 5e0 AS s, b02 * 1.3e2 AS p, b08 * 1e1 AS u FROM fx_pixels)))""",
)
def _(px):
    return px.select("cell", *(v.alias(k) for k, v in optics.physics_blend(C("b03") * 110.0, C("b04") * 5.0, C("b02") * 130.0, C("b08") * 10.0, 10.0).items()))


@query("m13_tree_spread", "fx_points fx_pixels")
def _(p, px):
    bands = ["b02", "b03", "b04", "b08"]
    t = joins.sampled_at(p, px, bands, 5e5, 3.4e6, 10.0).withColumn("depth_pos", F.abs("depth_m")).dropna(subset=bands)
    _, model = modelling.fit_depth_model(t, bands, "depth_pos")
    return modelling.tree_spread(model, px.select("cell", *bands), bands).select("cell", "tree_mean_m", "tree_std_m")


@query("p2_transects", "fx_points")
def _(p):
    return points.transects(p)


@query(
    "l6_stratified_cells", "fx_pixels", doubles="depth_m",
    twin="""WITH k AS (SELECT cell, b03 * 1e2 AS depth_m, floor(b03 * 1e2 + 1e-9) AS d, prow // 10 AS r, pcol // 10 AS c FROM fx_pixels WHERE scl > 2), n AS (SELECT d, r, c, count(*) AS n FROM k GROUP BY ALL)
        , t AS (SELECT CASE WHEN count(*) <= 500 THEN 1 ELSE 0 END AS one, count(*) AS s, sum(n)::BIGINT AS al FROM n),
        q AS (SELECT n.*, one, least(al, 500) - one * s AS lft, (n - one) * (least(al, 500) - one * s) AS due, al - one * s AS rest FROM n, t),
        f AS (SELECT *, due // rest AS wh, row_number() OVER (ORDER BY due % rest DESC, d, r, c) AS rk FROM q)
        SELECT cell, depth_m FROM (SELECT k.*, row_number() OVER (PARTITION BY k.d, k.r, k.c ORDER BY (cell * 7919 + 42) % 10007, cell) AS i FROM k) q JOIN f USING (d, r, c)
        WHERE i <= one + wh + CASE WHEN rk <= lft - (SELECT sum(wh) FROM f) THEN 1 ELSE 0 END""",
)
def _(px):
    cells = px.select("cell", "prow", "pcol", F.when(C("scl") > 2, C("b03") * 100.0 + 1e-9).alias("depth_m"))
    return pixels.stratified_cells(cells, "depth_m", 500).select("cell", (C("depth_m") - 1e-9).alias("depth_m"))


_FUSED = """WITH c AS (SELECT prow, pcol, b02 AS coastal FROM fx_pixels WHERE scl > 1), r AS (SELECT prow, pcol, b03 AS river FROM fx_pixels WHERE scl > 6), m AS (SELECT prow // 2 AS pr, pcol // 2 AS pc, avg(b04) AS measured FROM fx_pixels WHERE scl = 4 GROUP BY 1, 2),
    f AS (SELECT c.*, river, measured, coalesce(measured, river, coastal) AS depth, CASE WHEN measured IS NOT NULL THEN 3 WHEN river IS NOT NULL THEN 2 ELSE 1 END AS code FROM c LEFT JOIN r USING (prow, pcol) LEFT JOIN m ON pr = c.prow // 2 AND pc = c.pcol // 2)"""


def _fused(px):
    sources = {
        "measured": px.where("scl = 4").groupBy(F.floor(C("prow") / 2).cast("int").alias("prow"), F.floor(C("pcol") / 2).cast("int").alias("pcol")).agg(F.avg("b04").alias("depth")),
        "river": px.where("scl > 6").select("prow", "pcol", C("b03").alias("depth")),
        "coastal": px.where("scl > 1").select("prow", "pcol", C("b02").alias("depth")),
    }
    grids = {"measured": (5e5, 3.4e6, 20.0), "river": (5e5, 3.4e6, 10.0), "coastal": (5e5, 3.4e6, 10.0)}
    return pixels.fused_sources(sources, grids, lambda c: pixels.fused_priority(c, [("measured", 3), ("river", 2), ("coastal", 1)]))


@query("b7_fused_sources", "fx_pixels", doubles="depth measured river coastal", twin=f"{_FUSED} SELECT *, 'coastal' AS template FROM f")
def _(px):
    return _fused(px)[0]


@query("b7_fusion_statistics", "fx_pixels", doubles="least most mean", twin=f"{_FUSED} SELECT code, count(*) AS n, min(depth) AS least, max(depth) AS most, avg(depth) AS mean FROM f GROUP BY code")
def _(px):
    return _fused(px)[1]

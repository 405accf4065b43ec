"""Queries of joins, aggregates, windows, rasters, fusion, networks, models and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalspark.operators import joins, modelling, pixels, points, profiles, quality
from shoalspark.operators.quantiles import exact_quantiles, with_quantiles
from shoalspark.plans.registry import query
from shoalspark.sources import files

C = F.col


def _src(p, name):
    return p.where(C("source") == name)


_NEAREST = """SELECT * FROM (SELECT a.point_id, b.point_id AS ref_id, b.depth_m AS ref_depth, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist,
    row_number() OVER (PARTITION BY a.point_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.point_id) AS rn
    FROM {a} a JOIN {b} b ON abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r} WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= {r}) WHERE rn = 1"""
_PTS = "(SELECT * FROM fx_points WHERE source = '{}')"


def _nearest(a, b, r):
    return _NEAREST.format(a=a, b=b, r=r)


_CONFLICT = "SELECT p.point_id, p.x, p.y, p.depth_m, p.source, p.sample_weight FROM {a} p LEFT JOIN ({n}) n USING (point_id) WHERE n.ref_depth IS NULL OR abs(p.depth_m - n.ref_depth) <= 1.5"


@query(
    "j1_reference_conflicts", "fx_points", doubles="depth_m ref_dist",
    twin=f"""SELECT p.point_id, p.depth_m, n.ref_id, n.dist AS ref_dist FROM (SELECT * FROM fx_points WHERE source IN ('atl03', 'atl24')) p LEFT JOIN ({_nearest("(SELECT * FROM fx_points WHERE source IN ('atl03', 'atl24'))", _PTS.format("extra_xyz"), 30)}) n USING (point_id)
        WHERE n.ref_depth IS NULL OR abs(p.depth_m - n.ref_depth) <= 1.5""",
)
def _(p):
    kept = joins.reference_conflicts_removed(p.where(C("source").isin("atl03", "atl24")), _src(p, "extra_xyz"))
    return kept.select("point_id", "depth_m", "ref_id", "ref_dist")


_COLLOCATED = """pair AS ({n}), j AS (SELECT a.point_id, n.ref_id, a.x, a.y, a.depth_m AS d1, n.ref_depth AS d2, (a.depth_m + n.ref_depth) / 2 AS m, abs(a.depth_m - n.ref_depth) AS g FROM {a} a JOIN pair n USING (point_id)),
    fused AS (SELECT point_id, m AS depth_m, 'atl_agreed' AS source, NULL::DOUBLE AS w FROM j WHERE abs(m) >= 2 AND g <= 1 AND (abs(m) <= 0.5 OR g <= 0.15 * abs(m))
    UNION ALL SELECT point_id, d1, 'atl03', NULL FROM j WHERE abs(m) < 2 UNION ALL SELECT b.point_id, b.depth_m, 'atl24', NULL FROM j JOIN {b} b ON b.point_id = j.ref_id WHERE abs(m) < 2
    UNION ALL SELECT point_id, depth_m, 'atl03', NULL FROM {a} WHERE point_id NOT IN (SELECT point_id FROM pair) UNION ALL SELECT point_id, depth_m, 'atl24', NULL FROM {b} WHERE point_id NOT IN (SELECT ref_id FROM pair))"""


@query(
    "j2_collocation", "fx_points", doubles="depth_m",
    twin=f"WITH {_COLLOCATED.format(n=_nearest(_PTS.format('atl03'), _PTS.format('atl24'), 20), a=_PTS.format('atl03'), b=_PTS.format('atl24'))} SELECT point_id, depth_m, source FROM fused",
)
def _(p):
    return joins.collocated(_src(p, "atl03"), _src(p, "atl24")).select("point_id", "depth_m", "source")


_P3 = f"""WITH a1 AS ({_CONFLICT.format(a=_PTS.format("atl03"), n=_nearest(_PTS.format("atl03"), _PTS.format("extra_xyz"), 30))}), a2 AS ({_CONFLICT.format(a=_PTS.format("atl24"), n=_nearest(_PTS.format("atl24"), _PTS.format("extra_xyz"), 30))}),
    {_COLLOCATED.format(n=_nearest("a1", "a2", 20), a="a1", b="a2")},
    t AS (SELECT f.point_id, f.depth_m, f.source, coalesce(p.sample_weight, CASE f.source WHEN 'atl03' THEN 5.0 WHEN 'atl24' THEN 1.0 WHEN 'atl_agreed' THEN 6.0 END) AS w FROM fused f JOIN fx_points p USING (point_id)
    UNION ALL SELECT point_id, depth_m, source, coalesce(sample_weight, 10.0) FROM {_PTS.format("extra_xyz")})"""


@query(
    "p3_fused_training_table", "fx_points", doubles="share mean_weight total_weight effective_share",
    twin=f"""{_P3} SELECT source, count(*) AS n, avg(w) AS mean_weight, sum(w) AS total_weight, count(*) / sum(count(*)) OVER () AS share, sum(w) / sum(sum(w)) OVER () AS effective_share FROM t GROUP BY source""",
)
def fused_by_source(p):
    return points.composition(points.fused_training_table(p))


@query(
    "j3_j4_sample_raster", "fx_points fx_pixels", doubles="b02 b03",
    twin="SELECT p.point_id, x.b02, x.b03 FROM fx_points p LEFT JOIN fx_pixels x ON x.prow = CAST(floor((3.4e6 - p.y) / 10) AS INT) AND x.pcol = CAST(floor((p.x - 5e5) / 10) AS INT)",
)
def _(p, px):
    return joins.sampled_at(p, px, ["b02", "b03"], 5e5, 3.4e6, 10.0).select("point_id", "b02", "b03")


@query("j7_union_overlay", "fx_pixels", doubles="depth", twin="SELECT cell, CASE WHEN cell % 3 = 0 AND cell % 2 = 0 THEN NULL WHEN cell % 3 = 0 THEN b03 ELSE b02 END AS depth FROM fx_pixels")
def _(px):
    a, b = px.where("cell % 3 <> 0").select("cell", C("b02").alias("a")), px.where("cell % 2 <> 0 or cell % 3 <> 0").select("cell", C("b03").alias("b"))
    return px.select("cell").join(a.join(b, "cell", "full"), "cell", "left").select("cell", F.coalesce("a", "b").alias("depth"))


@query(
    "j14_gaps", "fx_points", twin="""SELECT point_id FROM fx_points p WHERE source = 'atl24' AND NOT EXISTS (SELECT 1 FROM fx_points q WHERE q.source IN ('multibeam', 'bathy_lidar') AND abs(p.x - q.x) <= 12 AND abs(p.y - q.y) <= 12 AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 12)"""
)
def _(p):
    return joins.gaps(_src(p, "atl24"), p.where(C("source").isin("multibeam", "bathy_lidar")), 12.0).select("point_id")


@query(
    "j13_j15_nearest_training_point", "fx_points", doubles="dist",
    twin="""SELECT point_id, ref_id, dist FROM (SELECT a.point_id, b.point_id AS ref_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist, row_number() OVER (PARTITION BY a.point_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.point_id) AS rn
        FROM (SELECT * FROM fx_points WHERE source = 'atl03') a, (SELECT * FROM fx_points WHERE source = 'multibeam') b) WHERE rn = 1""",
)
def _(p):
    right = _src(p, "multibeam").select(C("point_id").alias("ref_id"), C("x").alias("rx"), C("y").alias("ry"))
    return joins.knn(_src(p, "atl03").select("point_id", "x", "y"), right, 1, 20.0, "point_id", "ref_id").select("point_id", "ref_id", "dist")


@query(
    "j16_split_separation", "fx_points", doubles="least mean_m most",
    twin="""SELECT min(d) AS least, avg(d) AS mean_m, max(d) AS most FROM (SELECT a.point_id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM (SELECT * FROM fx_points WHERE track % 5 = 0 AND source = 'atl03') a, (SELECT * FROM fx_points WHERE track % 5 <> 0 AND source = 'multibeam') b GROUP BY 1)""",
)
def _(p):
    test, train = p.where("track % 5 = 0 and source = 'atl03'"), p.where("track % 5 <> 0 and source = 'multibeam'")
    right = train.select(C("point_id").alias("ref_id"), C("x").alias("rx"), C("y").alias("ry"))
    near = joins.knn(test.select("point_id", "x", "y"), right, 1, 30.0, "point_id", "ref_id")
    return near.agg(F.min("dist").alias("least"), F.avg("dist").alias("mean_m"), F.max("dist").alias("most"))


@query(
    "j20_overlap_statistics", "fx_stack", doubles="mean_diff median_diff rms_diff max_abs_diff",
    twin="SELECT count(d) AS n, avg(d) AS mean_diff, median(d) AS median_diff, sqrt(avg(d * d)) AS rms_diff, max(abs(d)) AS max_abs_diff FROM (SELECT a.b02 - b.b02 AS d FROM fx_stack a JOIN fx_stack b USING (prow, pcol) WHERE a.day_no = 1 AND b.day_no = 3)",
)
def _(st):
    return joins.overlap_statistics(st.where("day_no = 1"), st.where("day_no = 3"), "b02")


@query("j11_reach_attributes", "fx_sections", doubles="mean_width", twin="SELECT xs_id, m.mean_width FROM fx_sections JOIN (SELECT river_id, avg(width_m) AS mean_width FROM fx_sections GROUP BY river_id) m USING (river_id)")
def _(xs):
    return xs.join(xs.groupBy("river_id").agg(F.avg("width_m").alias("mean_width")), "river_id").select("xs_id", "mean_width")


# -- photons and points


@query(
    "a1_photon_bins", "fx_photons",
    twin="""SELECT granule, beam, lat_bin, height_bin, count(*) AS n FROM (SELECT granule, beam, CAST(least(floor((latitude - l0) / ((l1 - l0) / nl)), nl - 1) AS INT) AS lat_bin, CAST(least(floor((photon_height - h0) / ((h1 - h0) / nh)), nh - 1) AS INT) AS height_bin
        FROM (SELECT *, greatest(1.0, least(5000.0, round_even((l1 - l0) / 1e-3, 0))) AS nl, greatest(1.0, least(5000.0, round_even((h1 - h0) / 0.25, 0))) AS nh FROM (SELECT *, min(latitude) OVER w AS l0, max(latitude) OVER w AS l1, min(photon_height) OVER w AS h0, max(photon_height) OVER w AS h1 FROM fx_photons
        WINDOW w AS (PARTITION BY granule, beam)))) GROUP BY ALL""",
)
def _(ph):
    return points.photon_bins(ph, 1e-3, 0.25).groupBy("granule", "beam", "lat_bin", "height_bin").agg(F.count("*").alias("n"))


_BINNED = """SELECT *, CAST(least(floor((latitude - l0) / ((l1 - l0) / nl)), nl - 1) AS INT) AS lat_bin, CAST(least(floor((photon_height - h0) / ((h1 - h0) / nh)), nh - 1) AS INT) AS height_bin
    FROM (SELECT *, greatest(1.0, least(5000.0, round_even((l1 - l0) / 1e-3, 0))) AS nl, greatest(1.0, least(5000.0, round_even((h1 - h0) / 0.25, 0))) AS nh FROM (SELECT *, min(latitude) OVER w AS l0, max(latitude) OVER w AS l1, min(photon_height) OVER w AS h0, max(photon_height) OVER w AS h1
    FROM fx_photons WHERE conf >= 1 WINDOW w AS (PARTITION BY granule, beam)))"""


@query(
    "p4_a2_a3_photon_picks", "fx_photons", doubles="bottom_m depth_m frac_bottom",
    twin=f"""WITH b AS ({_BINNED}), c AS (SELECT granule, beam, lat_bin, height_bin, count(*) AS n, median(photon_height) AS h FROM b GROUP BY ALL),
    full_enough AS (SELECT granule, beam, greatest(2.0, quantile_cont(n, 0.75)) AS least_n FROM (SELECT granule, beam, lat_bin, max(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
    modes AS (SELECT granule, beam, height_bin AS mode_bin FROM (SELECT granule, beam, height_bin, row_number() OVER (PARTITION BY granule, beam ORDER BY sum(n) DESC, height_bin) AS r FROM c GROUP BY granule, beam, height_bin) WHERE r = 1),
    s AS (SELECT granule, beam, lat_bin, h AS surface_m FROM (SELECT *, row_number() OVER (PARTITION BY granule, beam, lat_bin ORDER BY n DESC, height_bin) AS r FROM c JOIN full_enough USING (granule, beam) JOIN modes USING (granule, beam) WHERE n >= least_n AND abs(height_bin - mode_bin) * 0.25 <= 5) WHERE r = 1),
    d AS (SELECT granule, beam, lat_bin, height_bin, surface_m, count(*) AS n, median(photon_height) AS h FROM b JOIN s USING (granule, beam, lat_bin) WHERE photon_height < surface_m - 0.5 GROUP BY ALL),
    k AS (SELECT *, sum(n) OVER w AS below, row_number() OVER (PARTITION BY granule, beam, lat_bin ORDER BY n DESC, height_bin) AS r FROM d WINDOW w AS (PARTITION BY granule, beam, lat_bin))
    SELECT granule, beam, lat_bin, n AS n_bottom, CAST(below AS BIGINT) AS n_subsurface, h AS bottom_m, h - surface_m AS depth_m, n / below AS frac_bottom FROM k WHERE r = 1 AND n >= 2""",
)
def _(ph):
    binned = points.photon_bins(ph.where("conf >= 1"), 1e-3, 0.25)
    return points.bottom_picks(binned, points.surface_heights(binned))


@query(
    "p5_w1_a4_segments", "fx_photons", doubles="latitude longitude photon_height conf delta_time",
    twin="""WITH s AS (SELECT *, coalesce(sqrt(pow((latitude - lag(latitude) OVER w) * 111320e0, 2) + pow((longitude - lag(longitude) OVER w) * 111320e0 * cos(radians(latitude)), 2)), 0) AS step FROM fx_photons WHERE conf >= 1 WINDOW w AS (PARTITION BY granule, beam ORDER BY delta_time, photon_height, conf)),
    a AS (SELECT *, round(sum(step) OVER (PARTITION BY granule, beam ORDER BY delta_time, photon_height, conf ROWS UNBOUNDED PRECEDING), 6) AS along_m FROM s)
    SELECT granule, beam, CAST(floor(along_m / 5e0) AS BIGINT) AS seg_id, median(latitude) AS latitude, median(longitude) AS longitude, median(photon_height) AS photon_height, median(conf) AS conf, median(delta_time) AS delta_time, count(*) AS n_photons FROM a GROUP BY ALL HAVING count(*) >= 2""",
)
def _(ph):
    return points.segments(ph.where("conf >= 1"))


@query("x42_a22_weights_by_source", "fx_points", doubles="mean_weight total_weight share effective_share",
    twin="""SELECT source, count(*) AS n, avg(w) AS mean_weight, sum(w) AS total_weight, count(*) / sum(count(*)) OVER () AS share, sum(w) / sum(sum(w)) OVER () AS effective_share FROM (SELECT source, coalesce(sample_weight,
        CASE source WHEN 'atl03' THEN 5.0 WHEN 'atl24' THEN 1.0 WHEN 'extra_xyz' THEN 10.0 ELSE 1.0 END) AS w FROM fx_points) GROUP BY source""")  # fmt: skip
def _(p):
    return points.composition(points.weighted(p))


_W = "CASE source WHEN 'bathy_lidar' THEN 25 WHEN 'multibeam' THEN 20 WHEN 'extra_xyz' THEN 10 WHEN 'atl24' THEN 6 WHEN 'atl03' THEN 3 END"


@query("w10_w17_thinning", "fx_points", twin=f"SELECT point_id FROM (SELECT point_id, row_number() OVER (PARTITION BY floor(x / 30), floor(y / 30) ORDER BY {_W} DESC, point_id) AS r FROM fx_points) WHERE r <= 1")
def _(p):
    return points.thinned(p, 30.0).select("point_id")


@query("w11_densified", "fx_points", twin=f"""SELECT point_id FROM (SELECT point_id, row_number() OVER (PARTITION BY floor(x / 100), floor(y / 100) ORDER BY {_W} DESC, point_id) AS r, floor(x / 100) AS cx, floor(y / 100) AS cy FROM fx_points) ORDER BY r, cx, cy, point_id LIMIT 500""")
def _(p):
    return points.densified(p, 100.0, 500).select("point_id")


@query("w15_tier_cap", "fx_points", twin=f"""SELECT point_id FROM fx_points ORDER BY CASE source WHEN 'atl03' THEN 3 WHEN 'atl24' THEN 2 WHEN 'extra_xyz' THEN 2 ELSE 1 END, ({_W}) * coalesce(sample_weight, 1.0) DESC, point_id LIMIT 2000""")
def _(p):
    return points.tier_capped(p, 2000).select("point_id")


@query("l5_source_cap", "fx_points", twin="SELECT point_id FROM (SELECT point_id, row_number() OVER (PARTITION BY source ORDER BY (point_id * 7919 + 42) % 10007, point_id) AS r FROM fx_points) WHERE r <= 300")
def _(p):
    return points.source_capped(p, 300).select("point_id")


@query("l4_hash_limit", "fx_points", twin="SELECT point_id FROM fx_points ORDER BY (point_id * 7919 + 42) % 10007, point_id LIMIT 1000")
def _(p):
    return p.orderBy(F.pmod(C("point_id") * 7919 + 42, F.lit(10007)), "point_id").limit(1000).select("point_id")


@query("f1_area_filter", "fx_points", twin="SELECT point_id FROM fx_points WHERE longitude BETWEEN -87.999 AND -87.995 AND latitude BETWEEN 30.49 AND 30.5")
def _(p):
    return p.where(files.in_box(C("longitude"), C("latitude"), (-87.999, -87.995, 30.49, 30.5))).select("point_id")


@query("u1_u4_union_difference", "fx_points", twin="SELECT point_id, source FROM fx_points WHERE source IN ('atl03', 'multibeam') AND point_id % 7 <> 0")
def _(p):
    both = _src(p, "atl03").unionByName(_src(p, "multibeam").drop("track"), allowMissingColumns=True)
    return both.join(p.where("point_id % 7 = 0").select("point_id"), "point_id", "left_anti").select("point_id", "source")


@query(
    "p1_complexity", "fx_points", doubles="spread gradient mean_dist complexity",
    twin=f"""WITH k AS (SELECT * FROM (SELECT a.point_id, a.depth_m, b.depth_m AS ref_depth, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist, row_number() OVER (PARTITION BY a.point_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.point_id) AS r FROM {_PTS.format("atl24")} a, {_PTS.format("extra_xyz")} b) WHERE r <= 20)
    SELECT *, 0.5 * least(1e0, spread / 5) + 0.3 * least(1e0, gradient) + 0.2 * least(1e0, 10 / greatest(mean_dist, 1e0)) AS complexity FROM (SELECT point_id, stddev_pop(ref_depth) AS spread, max(abs(ref_depth - depth_m) / greatest(dist, 1e0)) AS gradient, avg(dist) AS mean_dist FROM k GROUP BY point_id)""",
)
def _(p):
    a = _src(p, "atl24")
    right = _src(p, "extra_xyz").select(C("point_id").alias("ref_id"), C("x").alias("rx"), C("y").alias("ry"), C("depth_m").alias("ref_depth"))
    return points.local_complexity(joins.knn(a.select("point_id", "x", "y", "depth_m"), right, 20, 60.0, "point_id", "ref_id"))


# -- scenes and composites


@query("a9_temporal_composite", "fx_stack", doubles="b02 b03", twin="SELECT prow, pcol, median(b02) AS b02, median(b03) AS b03, CAST(round_even(median(scl), 0) AS INT) AS scl FROM fx_stack GROUP BY prow, pcol")
def _(st):
    return pixels.temporal_composite(st, ["b02", "b03"])


_OK, _DEEP = "scl NOT IN (0, 3, 8, 9, 10, 11)", "(b08 < 0.03 AND (b02 + b03 + b04) / 3 < 0.15)"
_METRICS = f"""SELECT day_no, count(*) AS n, avg(CASE WHEN {_OK} THEN 1.0 ELSE 0.0 END) AS valid, avg(CASE WHEN b08 > 0.05 THEN 1.0 ELSE 0.0 END) AS glint, avg(CASE WHEN {_DEEP} THEN 1.0 ELSE 0.0 END) AS deep,
    median(CASE WHEN {_OK} THEN b08 END) AS nir_median, median(CASE WHEN {_OK} THEN b04 END) AS red_median FROM fx_stack GROUP BY day_no"""


@query("a13_a14_date_scores", "fx_stack", doubles="valid glint deep nir_median red_median score", twin=f"SELECT *, 2 * (1 - valid) + glint + (1 - deep) AS score FROM ({_METRICS})")
def _(st):
    return pixels.date_scores(pixels.date_metrics(st))


@query(
    "a15_robust_z", "fx_stack", doubles="deep z",
    twin=f"""WITH m AS ({_METRICS}), c AS (SELECT median(deep) AS med, count(deep) AS n FROM m), d AS (SELECT median(abs(deep - med)) AS mad FROM m, c)
        SELECT day_no, deep, CASE WHEN c.n < 3 OR mad = 0 THEN 0 ELSE 0.6745 * (deep - med) / mad END AS z FROM m, c, d""",
)
def _(st):
    return pixels.robust_z(pixels.date_metrics(st).select("day_no", "deep"), "deep")


@query(
    "a16_l2_outlier_dates", "fx_stack",
    twin=f"""WITH m AS ({_METRICS}), c AS (SELECT median(nir_median) AS nm, median(red_median) AS rm, count(nir_median) AS nn, count(red_median) AS rn FROM m), d AS (SELECT median(abs(nir_median - nm)) AS nd, median(abs(red_median - rm)) AS rd FROM m, c),
    z AS (SELECT day_no, valid, CASE WHEN nn < 3 OR nd = 0 THEN 0 ELSE 0.6745 * (nir_median - nm) / nd END AS zn, CASE WHEN rn < 3 OR rd = 0 THEN 0 ELSE 0.6745 * (red_median - rm) / rd END AS zr FROM m, c, d)
    SELECT day_no, concat_ws(',', CASE WHEN zn > 3.5 THEN 'nir_median' END, CASE WHEN zr > 3.5 THEN 'red_median' END, CASE WHEN valid < 0.3 THEN 'valid' END) AS triggers, coalesce(zn > 3.5, false) OR coalesce(zr > 3.5, false) OR coalesce(valid < 0.3, false) AS outlier FROM z""",
)
def _(st):
    return pixels.outlier_dates(pixels.date_metrics(st)).select("day_no", "triggers", "outlier")


@query("a17_deep_reflectance", "fx_stack", doubles="b02 b03", twin=f"SELECT CASE WHEN count(*) >= 50 THEN quantile_cont(b02, 0.01) END AS b02, CASE WHEN count(*) >= 50 THEN quantile_cont(b03, 0.01) END AS b03, count(*) AS n FROM fx_stack WHERE {_DEEP}")
def _(st):
    return pixels.deep_reflectance(st, ["b02", "b03"])


_TILES = "(SELECT prow, pcol, scl, concat('T', CAST(day_no AS VARCHAR)) AS tile, b02, 1.0 + day_no AS w FROM fx_stack)"


def _tiles(st):
    return st.select("prow", "pcol", "scl", F.concat(F.lit("T"), C("day_no").cast("string")).alias("tile"), "b02", (1.0 + C("day_no")).alias("w"))


@query("a10_mosaic", "fx_stack", doubles="b02", twin=f"SELECT prow, pcol, sum(b02 * w) / sum(w) AS b02, CAST(arg_max(scl, w) AS BIGINT) AS scl FROM {_TILES} GROUP BY prow, pcol")
def _(st):
    return pixels.weighted_mosaic(_tiles(st), "b02", "w").withColumn("scl", C("scl").cast("long"))


@query("a11_tile_offsets", "fx_stack", doubles="offset_m", twin=f"SELECT t.tile, count(*) AS n, greatest(-0.03, least(0.03, median(r.b02 - t.b02))) AS offset_m FROM {_TILES} t JOIN {_TILES} r ON r.tile = 'T0' AND t.prow = r.prow AND t.pcol = r.pcol WHERE t.tile <> 'T0' GROUP BY t.tile")
def _(st):
    return pixels.tile_offsets(_tiles(st), "T0", "b02").withColumnRenamed("offset", "offset_m")


@query("w13_best_scene", "fx_scenes", doubles="cloud", twin="SELECT tile, day_no, arg_min(scene_id, cloud * 1000000 + scene_id) AS scene_id, min(cloud) AS cloud FROM fx_scenes GROUP BY tile, day_no")
def _(s):
    return s.groupBy("tile", "day_no").agg(F.min_by("scene_id", F.struct("cloud", "scene_id")).alias("scene_id"), F.min("cloud").alias("cloud"))


@query("u2_shared_dates", "fx_scenes", twin="""WITH c AS (SELECT day_no, count(DISTINCT tile) AS tiles FROM fx_scenes GROUP BY day_no), n AS (SELECT count(DISTINCT tile) AS n FROM fx_scenes), s AS (SELECT count(*) AS k FROM c, n WHERE tiles = n)
    SELECT day_no, tiles FROM c, n, s WHERE k < 2 OR tiles = n""")
def _(s):
    c = s.groupBy("day_no").agg(F.count_distinct("tile").alias("tiles"))
    n = s.agg(F.count_distinct("tile").alias("n"))
    with_n = c.crossJoin(F.broadcast(n))  # one row
    k = with_n.agg(F.count_if(C("tiles") == C("n")).alias("k"))
    return with_n.crossJoin(F.broadcast(k)).where((C("k") < 2) | (C("tiles") == C("n"))).select("day_no", "tiles")


@query("l1_ranked_dates", "fx_scenes", doubles="score", twin="SELECT day_no, sum(cloud * w) / sum(w) AS score FROM (SELECT day_no, tile, min(cloud) AS cloud, CASE tile WHEN 'T0' THEN 0.5 WHEN 'T1' THEN 0.3 ELSE 0.2 END AS w FROM fx_scenes GROUP BY day_no, tile) GROUP BY day_no ORDER BY round(score, 6), day_no LIMIT 10")
def _(s):
    w = F.when(C("tile") == "T0", 0.5).when(C("tile") == "T1", 0.3).otherwise(0.2)
    best = s.groupBy("day_no", "tile").agg(F.min("cloud").alias("cloud")).withColumn("w", w)
    return best.groupBy("day_no").agg((F.sum(C("cloud") * C("w")) / F.sum("w")).alias("score")).orderBy(F.round("score", 6), "day_no").limit(10)


@query("a54_mean_angles", "fx_scenes", doubles="sun_zenith", twin="SELECT tile, avg(sun_zenith) AS sun_zenith, count(*) AS n FROM fx_scenes GROUP BY tile")
def _(s):
    return s.groupBy("tile").agg(F.avg("sun_zenith").alias("sun_zenith"), F.count("*").alias("n"))


@query("s12_date_windows", "fx_scenes", twin="""SELECT scene_id, CAST(CAST(d0 + to_months(CAST(k * 2 AS INT)) AS DATE) AS VARCHAR) AS window_start, CAST(least(d1, CAST(d0 + to_months(CAST(k * 2 + 2 AS INT)) - INTERVAL 1 DAY AS DATE)) AS VARCHAR) AS window_end FROM (SELECT scene_id, DATE '2020-01-05' AS d0, CAST(DATE '2020-01-05' + CAST(200 + scene_id % 90 AS INT) AS DATE) AS d1 FROM fx_scenes), (SELECT unnest(range(0, 10)) AS k)
    WHERE d0 + to_months(CAST(k * 2 AS INT)) <= d1""")
def _(s):
    d = s.select("scene_id", F.lit("2020-01-05").cast("date").alias("d0"), F.date_add(F.lit("2020-01-05").cast("date"), (200 + C("scene_id") % 90).cast("int")).alias("d1"))
    return files.date_windows(d, "d0", "d1", 2).select("scene_id", C("window_start").cast("string").alias("window_start"), C("window_end").cast("string").alias("window_end"))


# -- statistics


@query("a18_attenuation_statistics", "fx_pixels", doubles="mean_kd median_kd std_kd p05 p95", twin="SELECT avg(b04) AS mean_kd, median(b04) AS median_kd, stddev_pop(b04) AS std_kd, quantile_cont(b04, 0.05) AS p05, quantile_cont(b04, 0.95) AS p95 FROM fx_pixels WHERE land = 0")
def _(px):
    wet = px.where("land = 0")
    q = exact_quantiles(wet, {"k": C("b04")}, {"median_kd": ("k", 0.5), "p05": ("k", 0.05), "p95": ("k", 0.95)})
    return with_quantiles(wet.agg(F.avg("b04").alias("mean_kd"), F.stddev_pop("b04").alias("std_kd")), q)


_Q = ", ".join(f"quantile_cont(depth_m, {p}) AS p{round(p * 100):02d}" for p in (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99))


@query("a19_depth_summary", "fx_points", doubles="least most negative p01 p05 p10 p25 p50 p75 p90 p95 p99", twin=f"SELECT count(depth_m) AS n, min(depth_m) AS least, max(depth_m) AS most, avg(CASE WHEN depth_m < 0 THEN 1.0 ELSE 0.0 END) AS negative, {_Q} FROM fx_points")
def _(p):
    return modelling.depth_summary(p)


@query("a19_depth_histogram", "fx_points", twin="SELECT CAST(floor(abs(depth_m)) AS INT) AS bin, count(*) AS n FROM fx_points GROUP BY 1")
def _(p):
    return modelling.depth_histogram(p)


_PRED = "(SELECT *, depth_m + ((point_id * 13) % 21 - 10) * 0.1 AS pred FROM fx_points)"


def _predicted(p):
    return p.withColumn("pred", C("depth_m") + (C("point_id") * 13 % 21 - 10) * 0.1)


_ACC = "sqrt(avg((pred - depth_m) * (pred - depth_m))) AS rmse, avg(abs(pred - depth_m)) AS mae, avg(pred - depth_m) AS bias, CASE WHEN var_pop(depth_m) > 0 THEN 1 - sum((pred - depth_m) * (pred - depth_m)) / (var_pop(depth_m) * count(*)) END AS r2, count(*) AS n"


@query("a20_a21_accuracy_by_source", "fx_points", doubles="rmse mae bias r2", twin=f"SELECT source, {_ACC} FROM {_PRED} GROUP BY source")
def _(p):
    return _predicted(p).groupBy("source").agg(*modelling.accuracy(C("depth_m"), C("pred")))


@query("a26_depth_bins", "fx_points", doubles="rmse mae bias lo hi", twin=f"SELECT bin, rmse, mae, bias, n, bin * 0.5 AS lo, (bin + 1) * 0.5 AS hi FROM (SELECT CAST(floor(abs(depth_m) / 0.5) AS INT) AS bin, {_ACC} FROM {_PRED} GROUP BY 1)")
def _(p):
    return modelling.depth_bins(_predicted(p), "depth_m", "pred").drop("r2")


@query("w14_support_depth", "fx_points", doubles="strict_m relaxed_m", twin="""WITH b AS (SELECT CAST(floor(abs(depth_m) / 0.5) AS INT) AS bin, count(*) AS n, sqrt(avg(pow(((point_id * 13) % 21 - 10) * 0.1, 2))) AS rmse FROM fx_points WHERE NOT (abs(depth_m) BETWEEN 8 AND 9) GROUP BY 1)
    SELECT min(k) * 0.5 AS strict_m, (SELECT (max(bin) + 1) * 0.5 FROM b) AS relaxed_m FROM (SELECT unnest(range(1, (SELECT max(bin) + 2 FROM b))) AS k) WHERE k NOT IN (SELECT bin FROM b)""")
def _(p):
    bins = modelling.depth_bins(_predicted(p).where("not (abs(depth_m) between 8 and 9)"), "depth_m", "pred")
    all_bins = bins.agg(F.max("bin").alias("last")).select(F.explode(F.sequence(F.lit(0), C("last") + 1)).alias("bin"))  # to one beyond the deepest
    full = all_bins.join(bins, "bin", "left").select("bin", ((C("bin") + 1) * 0.5).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"), "rmse")
    found = profiles.support_depth(full.where(C("bin") >= 1), target=1.0, least=1)
    return found


@query("a23_residual_summary", "fx_points", doubles="median mean mad rmse p90 p99", twin=f"""WITH r AS (SELECT pred - depth_m + 0.05 AS e FROM {_PRED}), m AS (SELECT median(e) AS m FROM r)
    SELECT count(e) AS n, median(e) AS median, avg(e) AS mean, median(abs(e - m)) AS mad, sqrt(avg(e * e)) AS rmse, quantile_cont(abs(e), 0.9) AS p90, quantile_cont(abs(e), 0.99) AS p99 FROM r, m""")
def _(p):
    return modelling.residual_summary(_predicted(p).select((C("pred") - C("depth_m") + 0.05).alias("e")), "e")


@query("a27_quantile_strata", "fx_points", twin="WITH q AS (SELECT quantile_cont(depth_m, [0.25, 0.5, 0.75]) AS q FROM fx_points) SELECT point_id, CAST(len(list_filter(q, lambda v: v < depth_m)) AS INT) AS stratum FROM fx_points, q")
def _(p):
    return modelling.stratified_split(p, "point_id", "depth_m", strata=4).select("point_id", C("stratum").cast("int").alias("stratum"))


@query("a28_training_bounds", "fx_pixels", doubles="lo hi", twin=" UNION ALL ".join(f"SELECT '{b}' AS feature, l - 0.1 * (h - l) AS lo, h + 0.1 * (h - l) AS hi FROM (SELECT quantile_cont({b}, 0.005) AS l, quantile_cont({b}, 0.995) AS h FROM fx_pixels)" for b in ("b02", "b03", "b04")))
def _(px):
    return modelling.training_bounds(px, ["b02", "b03", "b04"])


@query("f16_applicability", "fx_pixels", doubles="score", twin="SELECT cell, (exp(-3 * greatest(0, 0.03 - b02, b02 - 0.1) / 0.07) + exp(-3 * greatest(0, 0.03 - b03, b03 - 0.09) / 0.06)) / 2 AS score FROM fx_pixels")
def _(px):
    return px.select("cell", modelling.applicability({"b02": (0.03, 0.1), "b03": (0.03, 0.09)}).alias("score"))


@query("a29_coverage", "fx_points", twin="""WITH b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fx_points), c AS (SELECT CAST(least(9, floor((y - y0) / (y1 - y0) * 10)) AS INT) AS gr, CAST(least(9, floor((x - x0) / (x1 - x0) * 10)) AS INT) AS gc, count(*) AS n FROM fx_points, b GROUP BY 1, 2)
    SELECT r.r AS gr, q.c AS gc, coalesce(n, 0) AS n, coalesce(n, 0) >= 10 AS covered FROM (SELECT CAST(unnest(range(0, 10)) AS INT) AS r) r CROSS JOIN (SELECT CAST(unnest(range(0, 10)) AS INT) AS c) q LEFT JOIN c ON c.gr = r.r AND c.gc = q.c""")
def _(p):
    return modelling.coverage_grid(p)


@query("a31_spectral_diversity", "fx_pixels", doubles="spread cv", twin=" UNION ALL ".join(f"SELECT '{b}' AS feature, quantile_cont({b}, 0.95) - quantile_cont({b}, 0.05) AS spread, stddev_pop({b}) / avg({b}) AS cv FROM fx_pixels" for b in ("b02", "b03", "b04", "b08")))
def _(px):
    long = px.select(F.explode(F.array(*(F.struct(F.lit(b).alias("feature"), C(b).alias("v")) for b in ("b02", "b03", "b04", "b08")))).alias("e")).select("e.*")
    q = exact_quantiles(long, {"v": C("v")}, {"_lo": ("v", 0.05), "_hi": ("v", 0.95)}, ("feature",))
    found = with_quantiles(long.groupBy("feature").agg((F.stddev_pop("v") / F.avg("v")).alias("cv")), q, ("feature",))
    return found.select("feature", (C("_hi") - C("_lo")).alias("spread"), "cv")


@query("a32_track_diversity", "fx_points", twin="SELECT track, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM fx_points GROUP BY 1, 2")
def _(p):
    return p.groupBy("track", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("a38_width_stage_slope", "fx_measurements", doubles="beta r2", twin="SELECT site_no, regr_slope(stage_ft, width_ft) AS beta, regr_r2(stage_ft, width_ft) AS r2, count(*) AS n FROM fx_measurements GROUP BY site_no")
def _(m):
    return m.groupBy("site_no").agg(F.regr_slope("stage_ft", "width_ft").alias("beta"), F.regr_r2("stage_ft", "width_ft").alias("r2"), F.count("*").alias("n"))


@query("a39_site_coefficient", "fx_measurements", doubles="a cv width_m", twin="""SELECT site_no, median(a) AS a, stddev_samp(a) / avg(a) AS cv, median(w) AS width_m, count(*) AS n FROM (SELECT site_no, width_ft * 0.3048 AS w, area_sqft * 0.09290304 / (width_ft * 0.3048) * 2 / 1.3 / pow(width_ft * 0.3048, 0.5) AS a,
    discharge_cfs, quantile_cont(discharge_cfs, 0.25) OVER (PARTITION BY site_no) AS lo, quantile_cont(discharge_cfs, 0.75) OVER (PARTITION BY site_no) AS hi FROM fx_measurements) WHERE discharge_cfs BETWEEN lo AND hi GROUP BY site_no""")
def _(m):
    q = m.groupBy("site_no").agg(F.percentile("discharge_cfs", F.lit(0.25)).alias("lo"), F.percentile("discharge_cfs", F.lit(0.75)).alias("hi"))
    w = C("width_ft") * 0.3048
    t = m.join(q, "site_no").where(C("discharge_cfs").between(C("lo"), C("hi"))).withColumn("w", w).withColumn("k", C("area_sqft") * 0.09290304 / w * 2 / 1.3 / F.sqrt(w))
    return t.groupBy("site_no").agg(F.median("k").alias("a"), (F.stddev_samp("k") / F.avg("k")).alias("cv"), F.median("w").alias("width_m"), F.count("*").alias("n"))


@query("a41_raster_statistics", "fx_pixels", doubles="least most mean_v std_v median_v p95 share area_km2", twin="""SELECT count(v) AS n, count(v) / count(*) AS share, count(v) * 1e-4 AS area_km2, min(v) AS least, max(v) AS most, avg(v) AS mean_v, stddev_pop(v) AS std_v, median(v) AS median_v, quantile_cont(v, 0.95) AS p95
    FROM (SELECT CASE WHEN land = 0 THEN b03 END AS v FROM fx_pixels)""")
def _(px):
    v = px.select(F.when(C("land") == 0, C("b03")).alias("v"))
    q = exact_quantiles(v, {"v": C("v")}, {"median_v": ("v", 0.5), "p95": ("v", 0.95)})
    one = v.agg(F.count("v").alias("n"), (F.count("v") / F.count("*")).alias("share"), (F.count("v") * 1e-4).alias("area_km2"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("std_v"))
    return with_quantiles(one, q)


@query("a42_mask_share", "fx_pixels", doubles="share", twin="SELECT avg(land) AS share FROM fx_pixels")
def _(px):
    return px.agg(F.avg((C("land") == 1).cast("double")).alias("share"))


@query("a43_section_diagnostics", "fx_sections", doubles="mean_m most_m", twin="SELECT river_id, count(*) AS n, avg(depth_pred_m) AS mean_m, max(depth_pred_m) AS most_m FROM fx_sections GROUP BY river_id")
def _(xs):
    return xs.groupBy("river_id").agg(F.count("*").alias("n"), F.avg("depth_pred_m").alias("mean_m"), F.max("depth_pred_m").alias("most_m"))


@query("a5_a6_points_to_pixels", "fx_points", doubles="median_m least_m", twin="SELECT CAST(floor((3.4e6 - y) / 10) AS INT) AS prow, CAST(floor((x - 5e5) / 10) AS INT) AS pcol, median(depth_m) AS median_m, min(depth_m) AS least_m FROM fx_points GROUP BY 1, 2")
def _(p):
    return p.groupBy(F.floor((3.4e6 - C("y")) / 10).cast("int").alias("prow"), F.floor((C("x") - 5e5) / 10).cast("int").alias("pcol")).agg(F.median("depth_m").alias("median_m"), F.min("depth_m").alias("least_m"))


@query("a47_coherence", "fx_pixels", doubles="score", twin="""WITH d AS (SELECT b03, b03 - lag(b03) OVER (PARTITION BY prow ORDER BY pcol) AS d FROM fx_pixels), m AS (SELECT median(b03) AS mv, median(d) AS md FROM d) SELECT 1 / (1 + median(abs(d - md)) / median(abs(b03 - mv))) AS score FROM d, m""")
def _(px):
    from pyspark.sql import Window

    d = px.select("b03", (C("b03") - F.lag("b03").over(Window.partitionBy("prow").orderBy("pcol"))).alias("d"))
    m = exact_quantiles(d, {"v": C("b03"), "d": C("d")}, {"mv": ("v", 0.5), "md": ("d", 0.5)})  # one row
    apart = exact_quantiles(d.crossJoin(F.broadcast(m)), {"v": F.abs(C("b03") - C("mv")), "d": F.abs(C("d") - C("md"))}, {"v": ("v", 0.5), "d": ("d", 0.5)})
    return apart.select((1 / (1 + C("d") / C("v"))).alias("score"))


@query("a48_a49_band_relations", "fx_pixels", doubles="ratio log_range index_range", twin="SELECT median(b02) / median(b03) AS ratio, ln(quantile_cont(b03, 0.95)) - ln(quantile_cont(b03, 0.05)) AS log_range, quantile_cont(ln(b02) / ln(b03), 0.9) - quantile_cont(ln(b02) / ln(b03), 0.1) AS index_range FROM fx_pixels WHERE scl = 6")
def _(px):
    i = F.ln("b02") / F.ln("b03")
    wanted = {"blue": ("b02", 0.5), "green": ("b03", 0.5), "lo": ("b03", 0.05), "hi": ("b03", 0.95), "i0": ("i", 0.1), "i1": ("i", 0.9)}
    q = exact_quantiles(px.where("scl = 6"), {"b02": C("b02"), "b03": C("b03"), "i": i}, wanted)
    return q.select((C("blue") / C("green")).alias("ratio"), (F.ln("hi") - F.ln("lo")).alias("log_range"), (C("i1") - C("i0")).alias("index_range"))


@query("a53_profile_change", "fx_sections", doubles="rmse bias", twin="SELECT CAST(river_id AS BIGINT) AS river_id, sqrt(avg(pow(width_m / 50.0 - depth_pred_m, 2))) AS rmse, avg(width_m / 50.0 - depth_pred_m) AS bias, count(*) AS n FROM fx_sections GROUP BY ROLLUP (river_id)")
def _(xs):
    d = C("width_m") / 50 - C("depth_pred_m")
    return xs.rollup(C("river_id").cast("long").alias("river_id")).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), F.count("*").alias("n"))


# -- profiles and networks


@query("w2_w19_rolling_smooth", "fx_sections", doubles="smooth", twin="""WITH m AS (SELECT *, CASE WHEN count(wse_m) OVER w >= 4 THEN median(wse_m) OVER w END AS med FROM fx_sections WINDOW w AS (PARTITION BY river_id ORDER BY s_center_m ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
    SELECT xs_id, CASE WHEN count(med) OVER w >= 4 THEN avg(med) OVER w END AS smooth FROM m WINDOW w AS (PARTITION BY river_id ORDER BY s_center_m ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def _(xs):
    return profiles.rolling_smooth(xs, "river_id", "s_center_m", "wse_m", 9, 4).select("xs_id", "smooth")


@query(
    "w3_w4_surface_profile", "fx_sections", doubles="smooth_mm fitted_mm slope",
    # a monotone fit is the largest of the least means of runs that begin before a row and end after it, or the other way round
    twin="""WITH m AS (SELECT *, CASE WHEN count(wse_m) OVER w >= 4 THEN median(wse_m) OVER w END AS med FROM fx_sections WINDOW w AS (PARTITION BY river_id ORDER BY s_center_m ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
    s AS (SELECT *, CASE WHEN count(med) OVER w >= 4 THEN avg(med) OVER w END AS smooth FROM m WINDOW w AS (PARTITION BY river_id ORDER BY s_center_m ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
    k AS (SELECT *, row_number() OVER w AS i, sum(smooth) OVER (PARTITION BY river_id ORDER BY s_center_m ROWS UNBOUNDED PRECEDING) AS run, coalesce(covar_pop(s_center_m, smooth) OVER (PARTITION BY river_id) > 0, false) AS up FROM s WHERE smooth IS NOT NULL WINDOW w AS (PARTITION BY river_id ORDER BY s_center_m)),
    ab AS (SELECT a.river_id, a.up, a.i AS a, b.i AS b, (b.run - a.run + a.smooth) / (b.i - a.i + 1) AS v FROM k a JOIN k b ON a.river_id = b.river_id AND a.i <= b.i),
    f AS (SELECT river_id, i, CASE WHEN any_value(up) THEN max(low) ELSE min(high) END AS fitted FROM (SELECT k.river_id, k.i, ab.a, any_value(k.up) AS up, min(v) AS low, max(v) AS high FROM k JOIN ab ON k.river_id = ab.river_id AND ab.a <= k.i AND ab.b >= k.i GROUP BY k.river_id, k.i, ab.a) GROUP BY river_id, i)
    SELECT xs_id, smooth * 1e3 AS smooth_mm, fitted * 1e3 AS fitted_mm, CASE WHEN lag(fitted) OVER w IS NOT NULL AND lead(fitted) OVER w IS NOT NULL THEN greatest(1e-5, least(5e-2, abs(lead(fitted) OVER w - lag(fitted) OVER w) / (lead(s_center_m) OVER w - lag(s_center_m) OVER w))) END AS slope
    FROM k JOIN f USING (river_id, i) WINDOW w AS (PARTITION BY river_id ORDER BY s_center_m)""",
)
def _(xs):
    # in millimetres, as means of eight heights end at the seventh decimal of a metre, on the edge of rounding
    return profiles.surface_profile(xs).select("xs_id", (C("smooth") * 1e3).alias("smooth_mm"), (C("fitted") * 1e3).alias("fitted_mm"), "slope")


@query("w5_w6_slope", "fx_sections", doubles="slope", twin="""SELECT xs_id, greatest(1e-5, least(0.05, abs(lead(wse_m) OVER w - lag(wse_m) OVER w) / (lead(s_center_m) OVER w - lag(s_center_m) OVER w))) + CASE WHEN lag(wse_m) OVER w IS NULL OR lead(wse_m) OVER w IS NULL THEN NULL ELSE 0 END AS slope
    FROM fx_sections WINDOW w AS (PARTITION BY river_id ORDER BY s_center_m)""")
def _(xs):
    return profiles.central_slope(xs, "river_id", "s_center_m", "wse_m").select("xs_id", "slope")


@query("w7_w8_monotone_depth", "fx_sections", doubles="adjusted_m", twin="""SELECT xs_id, max(depth_pred_m + 0.05 * k) OVER (PARTITION BY river_id ORDER BY s_center_m ROWS UNBOUNDED PRECEDING) - 0.05 * k AS adjusted_m FROM (SELECT *, row_number() OVER (PARTITION BY river_id ORDER BY s_center_m) AS k FROM fx_sections)""")
def _(xs):
    return profiles.monotone_depth(xs, "river_id", "s_center_m", "depth_pred_m", 0.05).select("xs_id", "adjusted_m")


@query("w9_moving_average_bed", "fx_sections", doubles="bed_est_m", twin="""WITH r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY river_id) AS len, lead(s_center_m) OVER w - s_center_m AS ds FROM fx_sections WINDOW w AS (PARTITION BY river_id ORDER BY s_center_m)),
    n AS (SELECT river_id, CAST(least(max(len), greatest(3, round_even(4000.0 / median(ds), 0))) AS INT) AS n FROM r GROUP BY river_id),
    k AS (SELECT r.xs_id, r.river_id, n.n, greatest(1, least(r.len, r.i - n.n // 2 + o.o)) AS j FROM r JOIN n USING (river_id), (SELECT unnest(range(0, 2000)) AS o) o WHERE o.o < n.n)
    SELECT k.xs_id, avg(v.depth_pred_m) AS bed_est_m FROM k JOIN r v ON v.river_id = k.river_id AND v.i = k.j GROUP BY k.xs_id""")
def _(xs):
    return profiles.moving_average_bed(xs, "river_id", "s_center_m", "depth_pred_m", 4000.0).select("xs_id", "bed_est_m")


@query("w12_a52_seams", "fx_pixels", doubles="mean_diff max_diff std_diff", twin="SELECT count(d) AS n, avg(d) AS mean_diff, max(d) AS max_diff, stddev_pop(d) AS std_diff FROM (SELECT pcol, abs(b03 - lag(b03) OVER (PARTITION BY prow ORDER BY pcol)) AS d FROM fx_pixels) WHERE pcol % 16 = 0 AND d IS NOT NULL")
def _(px):
    return pixels.seam_differences(px, "b03", 16)


@query("g2_components", "fx_edges", twin="SELECT n AS node, (n // 25) * 25 AS component_id FROM (SELECT from_node AS n FROM fx_edges UNION SELECT to_node FROM fx_edges)")
def _(e):
    return profiles.components(e)


@query(
    "g3_stationing", "fx_edges fx_nodes", doubles="s_m",
    twin="""WITH c AS (SELECT node, (node // 25) * 25 AS component_id, coalesce((SELECT sum(length_m) FROM fx_edges f WHERE f.to_node <= n.node AND f.to_node > (n.node // 25) * 25), 0) AS s FROM fx_nodes n),
        q AS (SELECT component_id, CASE WHEN min(node) * 37 % 101 <= max(node) * 37 % 101 THEN min(node) ELSE max(node) END AS root FROM c GROUP BY component_id)
        SELECT c.node, c.component_id, abs(c.s - b.s) AS s_m FROM c JOIN q USING (component_id) JOIN c b ON b.node = q.root""",
)
def _(e, n):
    return profiles.stationed(e, profiles.components(e), n)


@query("a36_l3_longest_components", "fx_edges", doubles="length_m", twin="SELECT (from_node // 25) * 25 AS component_id, sum(length_m) AS length_m, count(*) AS edges FROM fx_edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(e):
    return profiles.longest_components(e, profiles.components(e), 3)


# -- neighbourhoods, fusion, interpolation


@query("n1_dilation", "fx_pixels", twin="""SELECT p.cell, EXISTS (SELECT 1 FROM fx_pixels q WHERE q.scl = 6 AND q.prow BETWEEN p.prow - 1 AND p.prow + 1 AND abs(q.prow - p.prow) + abs(q.pcol - p.pcol) <= 1) AS m FROM fx_pixels p""")
def _(px):
    return pixels.dilated(px.withColumn("m", C("scl") == 6), "m").select("cell", "m")


@query("n2_erosion", "fx_pixels", twin="""SELECT p.cell, NOT EXISTS (SELECT 1 FROM fx_pixels q WHERE q.scl = 6 AND abs(q.prow - p.prow) + abs(q.pcol - p.pcol) <= 1) AS m FROM fx_pixels p""")
def _(px):
    return pixels.eroded(px.withColumn("m", C("scl") != 6), "m").select("cell", "m")


@query("n3_median_filter", "fx_pixels", doubles="filtered", twin="SELECT p.cell, median(q.b03) AS filtered FROM fx_pixels p JOIN (SELECT prow + i AS prow, pcol + j AS pcol, b03 FROM fx_pixels, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) q ON p.prow = q.prow AND p.pcol = q.pcol GROUP BY p.cell")
def _(px):
    return pixels.median_filtered(px, "b03").select("cell", "filtered")


@query("n4_edge_distance", "fx_pixels", doubles="edge_m", twin="""SELECT p.prow, p.pcol, coalesce(min(10 * sqrt(pow(p.prow - q.prow, 2) + pow(p.pcol - q.pcol, 2))), 50.0) AS edge_m FROM (SELECT * FROM fx_pixels WHERE scl <> 6) p LEFT JOIN (SELECT * FROM fx_pixels WHERE scl = 6) q
    ON abs(p.prow - q.prow) <= 5 AND abs(p.pcol - q.pcol) <= 5 AND pow(p.prow - q.prow, 2) + pow(p.pcol - q.pcol, 2) <= 25 GROUP BY p.prow, p.pcol""")
def _(px):
    return pixels.edge_distance(px.withColumn("ok", C("scl") != 6), "ok", 50.0)


@query("n5_buffer_mask", "fx_pixels fx_points", twin="SELECT cell FROM fx_pixels p WHERE EXISTS (SELECT 1 FROM fx_points q WHERE q.source = 'multibeam' AND abs(p.x - q.x) <= 15 AND abs(p.y - q.y) <= 15 AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 15)")
def _(px, p):
    return pixels.buffer_mask(px, _src(p, "multibeam"), 15.0).select("cell")


@query("n8_n9_tiles_with_halo", "fx_pixels", doubles="weight_sum", twin="""WITH t AS (SELECT DISTINCT prow, pcol, b03, CAST(floor((prow + i) / 16.0) AS INT) AS tile_r, CAST(floor((pcol + j) / 16.0) AS INT) AS tile_c FROM fx_pixels, (SELECT unnest([-2, 0, 2]) AS i), (SELECT unnest([-2, 0, 2]) AS j))
    SELECT tile_r, tile_c, count(*) AS n, count(*) FILTER (WHERE tile_r = prow // 16 AND tile_c = pcol // 16) AS inner_n, sum(b03) AS weight_sum FROM t GROUP BY tile_r, tile_c""")
def _(px):
    t = pixels.tiles_with_halo(px.select("prow", "pcol", "b03"), 16, 2)
    return t.groupBy("tile_r", "tile_c").agg(F.count("*").alias("n"), F.count_if("inner").alias("inner_n"), F.sum("b03").alias("weight_sum"))


_CELLS = "(SELECT cell, CASE WHEN cell % 3 <> 0 THEN b02 * 100 END AS a, CASE WHEN cell % 4 <> 0 THEN b03 * 100 END AS b, CASE WHEN cell % 50 = 0 THEN 9.0 END AS m, CASE WHEN cell % 7 <> 0 THEN b04 * 100 END AS t, (pcol % 8) * 10.0 AS e, b02 AS ua, b03 AS ub FROM fx_pixels)"


def _cells(px):
    return px.select(
        "cell", F.when(C("cell") % 3 != 0, C("b02") * 100).alias("a"), F.when(C("cell") % 4 != 0, C("b03") * 100).alias("b"), F.when(C("cell") % 50 == 0, 9.0).alias("m"),
        F.when(C("cell") % 7 != 0, C("b04") * 100).alias("t"), (C("pcol") % 8 * 10.0).alias("e"), C("b02").alias("ua"), C("b03").alias("ub"),
    )


@query("b1_priority", "fx_pixels", doubles="depth", twin=f"SELECT cell, coalesce(m, a, b) AS depth, CASE WHEN m IS NOT NULL THEN 3 WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 ELSE 0 END AS code FROM {_CELLS}")
def _(px):
    return pixels.fused_priority(_cells(px), [("m", 3), ("a", 1), ("b", 2)]).select("cell", "depth", "code")


@query("b2_weighted", "fx_pixels", doubles="depth", twin=f"SELECT cell, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.7 * a + 0.3 * b ELSE coalesce(a, b) END AS depth, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 6 WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 ELSE 0 END AS code FROM {_CELLS}")
def _(px):
    return pixels.fused_weighted(_cells(px), "a", "b").select("cell", "depth", "code")


@query("b3_taper", "fx_pixels", doubles="depth", twin=f"""SELECT cell, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN w * b + (1 - w) * a ELSE coalesce(b, a) END AS depth, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 6 WHEN b IS NOT NULL THEN 2 WHEN a IS NOT NULL THEN 1 ELSE 0 END AS code
    FROM (SELECT *, 0.3 + least(1.0, e / 50) * 0.7 AS w FROM {_CELLS})""")
def _(px):
    return pixels.fused_tapered(_cells(px), "a", "b", "e").select("cell", "depth", "code")


@query("b4_least_uncertain", "fx_pixels", doubles="depth sigma", twin=f"""SELECT cell, CASE WHEN a IS NOT NULL AND (b IS NULL OR ua <= ub) THEN a ELSE b END AS depth, CASE WHEN a IS NOT NULL AND (b IS NULL OR ua <= ub) THEN ua WHEN b IS NOT NULL THEN ub END AS sigma,
    CASE WHEN a IS NOT NULL AND (b IS NULL OR ua <= ub) THEN 1 WHEN b IS NOT NULL THEN 2 ELSE 0 END AS code FROM {_CELLS}""")
def _(px):
    return pixels.fused_least_uncertain(_cells(px), [("a", "ua", 1), ("b", "ub", 2)]).select("cell", "depth", "sigma", "code")


@query("b5_average", "fx_pixels", doubles="depth", twin=f"SELECT cell, list_avg(list_filter([a, b, t], lambda v: v IS NOT NULL)) AS depth, CASE len(list_filter([a, b, t], lambda v: v IS NOT NULL)) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 5 END AS code FROM {_CELLS}")
def _(px):
    return pixels.fused_average(_cells(px), ["a", "b", "t"]).select("cell", "depth", "code")


@query("b6_blend", "fx_pixels", doubles="depth", twin=f"""SELECT cell, coalesce(m, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(1.0, e / 50) * a + (1 - least(1.0, e / 50)) * b ELSE coalesce(a, b) END, t) AS depth,
    CASE WHEN m IS NOT NULL THEN 3 WHEN a IS NOT NULL AND b IS NOT NULL THEN 6 WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN t IS NOT NULL THEN 4 ELSE 0 END AS code FROM {_CELLS}""")
def _(px):
    return pixels.fused_blend(_cells(px), "m", "a", "b", "t", "e").select("cell", "depth", "code")


@query("a46_provenance_counts", "fx_pixels", twin=f"SELECT CASE WHEN m IS NOT NULL THEN 3 WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 ELSE 0 END AS code, count(*) AS n FROM {_CELLS} GROUP BY 1")
def _(px):
    return pixels.fused_priority(_cells(px), [("m", 3), ("a", 1), ("b", 2)]).groupBy("code").agg(F.count("*").alias("n"))


@query("i8_tapered_patch", "fx_pixels", doubles="depth", twin=f"""SELECT cell, CASE WHEN u AND a IS NOT NULL THEN w * b + (1 - w) * a WHEN u THEN b ELSE a END AS depth, CASE WHEN m IS NOT NULL THEN 2 WHEN cell % 11 = 0 THEN 3 WHEN u AND a IS NOT NULL AND w < 1 THEN 5 WHEN u THEN 1 ELSE 0 END AS code
    FROM (SELECT *, least(1.0, e / 50) AS w, b IS NOT NULL AND m IS NULL AND cell % 11 <> 0 AS u FROM {_CELLS})""")
def _(px):
    return pixels.tapered_patch(_cells(px), "a", "b", "e", C("m").isNotNull(), C("cell") % 11 == 0).select("cell", "depth", "code")


_IDW = """WITH c AS (SELECT p.cell, q.point_id, q.depth_m AS v, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d FROM fx_pixels p, (SELECT * FROM fx_points WHERE source = 'multibeam') q),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY d, point_id) AS r FROM c) WHERE r <= 6)"""


@query("i1_inverse_distance", "fx_pixels fx_points", doubles="depth nearest_m", twin=f"{_IDW} SELECT cell, coalesce(min(CASE WHEN d <= 1e-6 AND r = 1 THEN v END), sum(v / pow(d + 1e-6, 2)) / sum(1 / pow(d + 1e-6, 2))) AS depth, min(d) AS nearest_m, count(*) AS n FROM k GROUP BY cell")
def _(px, p):
    return pixels.inverse_distance(px, _src(p, "multibeam"), "depth_m", k=6)


@query("i2_adaptive_power", "fx_pixels fx_points", doubles="depth nearest_m", twin=f"""{_IDW}, w AS (SELECT *, 1.5 + log10(greatest(1.0, least(10.0, max(d) OVER (PARTITION BY cell) / greatest(min(d) OVER (PARTITION BY cell), 1e-6)))) * 2.5 AS p FROM k)
    SELECT cell, coalesce(min(CASE WHEN d <= 1e-6 AND r = 1 THEN v END), sum(v / pow(d + 1e-6, p)) / sum(1 / pow(d + 1e-6, p))) AS depth, min(d) AS nearest_m, count(*) AS n FROM w GROUP BY cell""")
def _(px, p):
    return pixels.inverse_distance(px, _src(p, "multibeam"), "depth_m", k=6, adaptive=True)


@query(
    "i5_residual_fill", "fx_pixels fx_points", doubles="depth sigma",
    twin="""WITH e AS (SELECT q.point_id, q.x, q.y, q.depth_m + p.b03 * 100 AS e FROM fx_points q JOIN fx_pixels p ON p.prow = CAST(floor((3.4e6 - q.y) / 10) AS INT) AND p.pcol = CAST(floor((q.x - 5e5) / 10) AS INT) WHERE q.source = 'multibeam'), s AS (SELECT avg(e) AS m, stddev_pop(e) AS s FROM e),
    b AS (SELECT point_id, x, y, greatest(-10e0, least(10e0, least(greatest(e, m - 4 * s), m + 4 * s))) AS v FROM e, s),
    k AS (SELECT * FROM (SELECT p.cell, p.b03, b.v, sqrt(pow(p.x - b.x, 2) + pow(p.y - b.y, 2)) AS d, row_number() OVER (PARTITION BY p.cell ORDER BY sqrt(pow(p.x - b.x, 2) + pow(p.y - b.y, 2)), b.point_id) AS r FROM fx_pixels p, b) WHERE r <= 8)
    SELECT cell, depth, sqrt(25e-2 + pow(2e-1 * (1 + 5e-1 * near / 1500), 2)) AS sigma, CAST(CASE WHEN near <= 1e-6 THEN 12 ELSE 11 END AS INT) AS code
    FROM (SELECT cell, min(d) AS near, -any_value(b03) * 100 + coalesce(min(CASE WHEN d <= 1e-6 AND r = 1 THEN v END), sum(v / pow(d + 1e-6, 2)) / sum(1 / pow(d + 1e-6, 2))) AS depth FROM k GROUP BY cell)""",
)
def _(px, p):
    prior = px.withColumn("depth_m", -C("b03") * 100)
    return pixels.residual_fill(prior, _src(p, "multibeam"), 5e5, 3.4e6, 10.0)


# -- models


@query("m1_stratified_split", "fx_points", twin="""WITH q AS (SELECT quantile_cont(depth_m, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS q FROM fx_points),
    s AS (SELECT point_id, len(list_filter(q, lambda v: v < depth_m)) AS st FROM fx_points, q) SELECT point_id, percent_rank() OVER (PARTITION BY st ORDER BY (point_id * 7919 + 42) % 10007, point_id) < 0.2 AS is_test FROM s""")
def _(p):
    return modelling.stratified_split(p, "point_id", "depth_m").select("point_id", "is_test")


@query("m3_block_folds", "fx_points", twin="SELECT point_id, CAST(((floor(x / 300)::BIGINT * 31 + floor(y / 300)::BIGINT * 17) % 5 + 5) % 5 AS INT) AS fold FROM fx_points")
def _(p):
    return modelling.block_folds(p, 300.0, 5).select("point_id", "fold")


@query("m5_track_folds", "fx_points", twin="SELECT track, n, CAST(row_number() OVER (ORDER BY n DESC, track) - 1 AS INT) AS fold FROM (SELECT track, count(*) AS n FROM fx_points GROUP BY track ORDER BY n DESC, track LIMIT 8)")
def _(p):
    return modelling.track_folds(p, 8)


@query("m6_buffered_train", "fx_points", twin="""WITH f AS (SELECT *, CAST(((floor(x / 300)::BIGINT * 31 + floor(y / 300)::BIGINT * 17) % 5 + 5) % 5 AS INT) AS fold FROM fx_points), t AS (SELECT DISTINCT x, y FROM f WHERE fold = 2)
    SELECT point_id FROM f WHERE fold <> 2 AND NOT EXISTS (SELECT 1 FROM t WHERE abs(f.x - t.x) <= 25 AND abs(f.y - t.y) <= 25 AND sqrt(pow(f.x - t.x, 2) + pow(f.y - t.y, 2)) <= 25)""")
def _(p):
    return modelling.buffered_train(modelling.block_folds(p, 300.0, 5), 2, 25.0).select("point_id")


@query("m10_index_line", "fx_pixels", doubles="slope intercept r2", twin="SELECT regr_slope(b03 * 90, ln(b02)) AS slope, regr_intercept(b03 * 90, ln(b02)) AS intercept, regr_r2(b03 * 90, ln(b02)) AS r2 FROM fx_pixels")
def _(px):
    return modelling.index_line(px.select((C("b03") * 90).alias("z"), F.ln("b02").alias("i")), "i", "z")


@query("m21_m22_bin_shifts", "fx_points", doubles="shift", twin=f"""SELECT bin, median(pred - depth_m) AS shift, count(*) AS n FROM (SELECT *, CASE WHEN z < 2 THEN 0 WHEN z < 5 THEN 1 WHEN z < 10 THEN 2 WHEN z < 20 THEN 3 WHEN z < 30 THEN 4 WHEN z <= 40 THEN 5 END AS bin FROM (SELECT *, abs(depth_m) AS z FROM {_PRED})) WHERE bin IS NOT NULL GROUP BY bin""")
def _(p):
    return modelling.bin_shifts(_predicted(p).withColumn("e", C("pred") - C("depth_m")), "depth_m", "e")


@query("m23_planar_shift", "fx_points")
def _(p):
    t = _predicted(p).withColumn("e", C("pred") - C("depth_m") + 1e-3 * (C("x") - 5e5))
    a, b, c = modelling.planar_shift(t, "e")
    return t.select("point_id", (C("e") - (a + b * C("x") + c * C("y"))).alias("aligned"))


@query("m9_m12_depth_model", "fx_points fx_pixels")
def _(p, px):
    bands = ["b02", "b03", "b04", "b08"]
    t = joins.sampled_at(p, px, bands, 5e5, 3.4e6, 10.0).withColumn("depth_pos", F.abs("depth_m")).dropna(subset=bands)
    t = modelling.block_folds(t, 300.0, 5)
    assembler, model = modelling.fit_depth_model(t.where("fold <> 0"), bands, "depth_pos")
    scored = model.transform(assembler.transform(t.where("fold = 0")))
    return scored.groupBy("source").agg(*modelling.accuracy(C("depth_pos"), C("predicted_m")))


_BOTTOM = {"b02": (0.015, 0.17, 0.3, 0.05), "b03": (0.012, 0.21, 0.35, 0.1), "b04": (0.008, 0.63, 0.4, 0.05)}  # deep reflectance, both attenuations, sand, grass
_E = {b: f"exp(-{k}::DOUBLE * z)" for b, (_, k, _, _) in _BOTTOM.items()}
_RHO = {b: f"(sh * {sand}::DOUBLE + (1 - sh) * {grass}::DOUBLE)" for b, (_, _, sand, grass) in _BOTTOM.items()}
_RES = {b: f"({b} - ({deep}::DOUBLE * (1 - {_E[b]}) + {_RHO[b]} / pi() * {_E[b]}))" for b, (deep, _, _, _) in _BOTTOM.items()}
_JZ = {b: f"({k}::DOUBLE * {_E[b]} * ({deep}::DOUBLE - {_RHO[b]} / pi()))" for b, (deep, k, _, _) in _BOTTOM.items()}
_JS = {b: f"(({sand}::DOUBLE - {grass}::DOUBLE) / pi() * {_E[b]})" for b, (_, _, sand, grass) in _BOTTOM.items()}
_RMS = f"sqrt(({' + '.join(f'pow({r}, 2)' for r in _RES.values())}) / 3)"


def _newton(j):
    return f"({' + '.join(f'{_RES[b]} * {j[b]}' for b in j)}) / ({' + '.join(f'pow({v}, 2)' for v in j.values())} + 1e-2)"


@query(
    "m15_physics_inversion", "fx_pixels", doubles="depth_m sand residual sigma_m",
    twin=f"""WITH RECURSIVE t AS (SELECT cell, b02, b03, b04, 0 AS i, 5e0 AS z, 5e-1 AS sh, true AS live FROM fx_pixels UNION ALL
    SELECT cell, b02, b03, b04, i + 1, CASE WHEN on_it THEN greatest(1e-1, least(3e1, z + {_newton(_JZ)})) ELSE z END, CASE WHEN on_it THEN greatest(0e0, least(1e0, sh + {_newton(_JS)})) ELSE sh END, on_it FROM (SELECT *, live AND {_RMS} >= 1e-3 AS on_it FROM t WHERE i < 20))
    SELECT cell, z AS depth_m, sh AS sand, {_RMS} AS residual, greatest(3e-1, least(5e0, 5e-1 + 2 * {_RMS} / greatest((15e-3 + 12e-3 + 8e-3) / 3, 1e-2) + 5e-2 * z)) AS sigma_m FROM t WHERE i = 20""",
)
def _(px):
    return modelling.physics_inversion(px, ["b02", "b03", "b04"], [0.015, 0.012, 0.008], [0.08, 0.1, 0.3], [0.09, 0.11, 0.33], [0.3, 0.35, 0.4], [0.05, 0.1, 0.05])


# -- checks


@query("q1_q6_checks", "fx_points", doubles="value", twin=f"""SELECT 'extra_xyz_present' AS "check", count(*) > 0 AS passed, count(*) * 1.0 AS value, 'ok' AS message, true AS critical FROM fx_points WHERE source = 'extra_xyz'
    UNION ALL SELECT 'extra_xyz_weight', abs(avg(sample_weight) - 1) <= 0.1, avg(sample_weight), 'ok', false FROM fx_points WHERE source = 'extra_xyz' UNION ALL SELECT 'enough_rows', count(*) >= 100, count(*), 'ok', true FROM fx_points
    UNION ALL SELECT 'rmse', sqrt(avg(pow(pred - depth_m, 2))) < 2, sqrt(avg(pow(pred - depth_m, 2))), 'ok', true FROM {_PRED} UNION ALL SELECT 'depth_sign', true, avg(CASE WHEN depth_m > 0 THEN 1.0 ELSE 0.0 END), 'ok', true FROM fx_points""")
def _(p):
    s = quality.Suite().add(quality.source_present(p)).add(quality.mean_weight_near(p, "extra_xyz", 1.0)).add(quality.enough_rows(p))
    return s.add(quality.rmse_below(_predicted(p), "depth_m", "pred")).add(quality.depth_sign(p)).run()


@query(
    "q4_suite_summary", "fx_points", doubles="pass_rate",
    twin=f"""WITH c AS (SELECT true AS critical, count(*) FILTER (source = 'extra_xyz') > 0 AS ok FROM fx_points UNION ALL SELECT true, count(*) FILTER (source = 'nowhere') > 0 FROM fx_points
        UNION ALL SELECT true, avg(CASE WHEN depth_m > 0 THEN 1.0 ELSE 0.0 END) <= 0.9 FROM fx_points UNION ALL SELECT false, abs(avg(sample_weight) FILTER (source = 'extra_xyz') - 3) <= 0.3 FROM fx_points
        UNION ALL SELECT true, sqrt(avg(pow(pred - depth_m, 2))) < 0.01 FROM {_PRED})
        SELECT count(*) AS n, count(*) FILTER (ok) AS passed, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS pass_rate, count(*) FILTER (critical AND NOT ok) AS critical_failures FROM c""",
)
def _(p):
    s = quality.Suite().add(quality.source_present(p)).add(quality.source_present(p, "nowhere")).add(quality.depth_sign(p))
    return s.add(quality.mean_weight_near(p, "extra_xyz", 3.0)).add(quality.rmse_below(_predicted(p), "depth_m", "pred", 0.01)).summary()


@query("q5_area_rules", "fx_points", twin="""SELECT point_id, CASE WHEN point_id % 4 = 0 THEN 'west is not below east' ELSE '' END AS messages FROM fx_points""")
def _(p):
    w, e = C("longitude"), C("longitude") + F.when(C("point_id") % 4 == 0, -1.0).otherwise(1.0)
    return p.select("point_id", F.concat_ws("; ", quality.area_messages(w, e, C("latitude"), C("latitude") + 1)).alias("messages"))


@query(
    "q7_grid_compatibility", "fx_pixels", doubles="value",
    twin="""WITH g AS (SELECT min(x) AS x0, max(y) AS y0, max(pcol) + 1 AS ncol, min(x) FILTER (scl = 6) AS x6, max(y) FILTER (scl = 6) AS y6, max(pcol) FILTER (scl = 6) + 1 AS n6 FROM fx_pixels),
        v AS (SELECT name, value, value = 0 AS passed FROM (SELECT 'whole' AS name, 0.0 AS value FROM g WHERE x0 IS NOT NULL UNION ALL SELECT 'water', CAST((x0 IS DISTINCT FROM x6)::INT + (y0 IS DISTINCT FROM y6)::INT + (ncol IS DISTINCT FROM n6)::INT AS DOUBLE) FROM g))
        SELECT name, 'same_grid' AS "check", passed, value, CASE WHEN passed THEN 'ok' ELSE 'grids differ' END AS message, true AS critical FROM v""",
)
def _(px):
    grid = lambda d: d.agg(F.min("x").alias("x0"), F.max("y").alias("y0"), (F.max("pcol") + 1).alias("ncol"))
    named = lambda name, d: quality.same_grid(grid(px), grid(d)).select(F.lit(name).alias("name"), "*")
    return named("whole", px).unionByName(named("water", px.where("scl = 6")))


@query("q8_nonfinite_report", "fx_points", twin="SELECT 'depth_m' AS \"column\", count(*) AS n, count(*) - count(depth_m) AS nonfinite FROM fx_points UNION ALL SELECT 'sample_weight', count(*), count(*) - count(sample_weight) FROM fx_points")
def _(p):
    return quality.nonfinite_report(p, ["depth_m", "sample_weight"])

"""Queries of as-of joins, modes of residuals, date choice in two phases and whole scene prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalspark.functions import optics
from shoalspark.operators import joins, modelling, pipelines, pixels, surveys
from shoalspark.plans.registry import query
from shoalspark.plans.table_queries import _METRICS

C = F.col
BANDS = ["b02", "b03", "b04", "b08"]

_FIRST = "SELECT granule, beam, first(latitude ORDER BY delta_time, latitude, longitude) AS la, first(longitude ORDER BY delta_time, latitude, longitude) AS lo, min(latitude) AS la0, max(latitude) AS la1, min(longitude) AS lo0, max(longitude) AS lo1 FROM fx_photons GROUP BY ALL"
_FAR = "round(sqrt(pow((p.latitude - f.la) * 111320e0, 2) + pow((p.longitude - f.lo) * 111320e0 * cos(radians(p.latitude)), 2)), 6)"
_LINKED = f"""f AS ({_FIRST}), raw AS (SELECT p.*, {_FAR} AS dist_m FROM fx_photons p JOIN f USING (granule, beam)),
    n AS (SELECT granule, beam, CAST(floor(dist_m / 5e2) AS BIGINT) AS chunk, count(*) AS n_raw FROM raw GROUP BY ALL), far AS (SELECT granule, beam, max(dist_m) AS far FROM raw GROUP BY ALL),
    pk AS (SELECT r.granule, r.beam, r.latitude, r.longitude, r.photon_height AS ws_h, r.dist_m, CAST(floor(r.dist_m / 5e2) AS BIGINT) AS chunk FROM raw r JOIN far USING (granule, beam) WHERE conf = 4 AND photon_height > -1 AND floor(dist_m / 5e2) * 5e2 < far)"""


def _linked(ph, p):
    picks = ph.where("conf = 4 and photon_height > -1").select("granule", "beam", "latitude", "longitude", C("photon_height").alias("ws_h"))
    return surveys.linked_chunks(picks, ph, p, ["granule", "beam"], "delta_time", 500.0, 0.01)


@query("j22_linked_picks", "fx_photons fx_points", doubles="dist_m ws_h", twin=f"WITH {_LINKED} SELECT granule, beam, chunk, dist_m, ws_h, coalesce(n_raw, 0) AS n_raw FROM pk LEFT JOIN n USING (granule, beam, chunk)")
def _(ph, p):
    return _linked(ph, p)[0].select("granule", "beam", "chunk", "dist_m", "ws_h", "n_raw")


@query(
    "j22_surface_at_points", "fx_photons fx_points", doubles="dist_m surface_m",
    twin=f"""WITH {_LINKED}, k AS (SELECT granule, beam, chunk, dist_m, avg(ws_h) AS h FROM pk GROUP BY ALL),
    s AS (SELECT p.point_id, f.granule, f.beam, {_FAR} AS dist_m FROM fx_points p JOIN f ON p.latitude BETWEEN f.la0 - 1e-2 AND f.la1 + 1e-2 AND p.longitude BETWEEN f.lo0 - 1e-2 AND f.lo1 + 1e-2),
    c AS (SELECT *, CAST(floor(dist_m / 5e2) AS BIGINT) AS chunk FROM s), q AS (SELECT c.* FROM c SEMI JOIN k USING (granule, beam, chunk)),
    b AS (SELECT q.*, k.dist_m AS d0, k.h AS h0 FROM q ASOF LEFT JOIN k ON q.granule = k.granule AND q.beam = k.beam AND q.chunk = k.chunk AND q.dist_m >= k.dist_m),
    a AS (SELECT b.*, k.dist_m AS d1, k.h AS h1 FROM b ASOF LEFT JOIN k ON b.granule = k.granule AND b.beam = k.beam AND b.chunk = k.chunk AND b.dist_m <= k.dist_m)
    SELECT point_id, granule, beam, chunk, dist_m, CASE WHEN d0 IS NULL THEN h1 WHEN d1 IS NULL OR d0 = d1 THEN h0 ELSE h0 + (h1 - h0) * ((dist_m - d0) / (d1 - d0)) END AS surface_m FROM a""",
)
def _(ph, p):
    return _linked(ph, p)[1].select("point_id", "granule", "beam", "chunk", "dist_m", "surface_m")


@query(
    "j18_nearest_prediction", "fx_points", doubles="height_m",
    twin="""WITH r AS (SELECT point_id, track % 5 AS station, epoch(ts)::DOUBLE AS t FROM fx_points), h AS (SELECT station, floor(t / 3600e0) * 3600e0 AS t, avg(depth_m) AS v FROM (SELECT track % 5 AS station, epoch(ts)::DOUBLE AS t, depth_m FROM fx_points WHERE source = 'multibeam') GROUP BY ALL),
    b AS (SELECT r.*, h.t AS t0, h.v AS v0 FROM r ASOF LEFT JOIN h ON r.station = h.station AND r.t >= h.t), a AS (SELECT b.*, h.t AS t1, h.v AS v1 FROM b ASOF LEFT JOIN h ON b.station = h.station AND b.t <= h.t)
    SELECT point_id, CASE WHEN t0 IS NOT NULL AND (t1 IS NULL OR t - t0 <= t1 - t) THEN v0 ELSE v1 END AS height_m FROM a""",
)
def _(p):
    t = p.select("point_id", (C("track") % 5).alias("station"), C("ts").cast("timestamp").cast("double").alias("t"), "depth_m", "source")
    hourly = t.where("source = 'multibeam'").groupBy("station", (F.floor(C("t") / 3600) * 3600.0).alias("t")).agg(F.avg("depth_m").alias("height_m"))
    return surveys.nearest_prediction(t.select("point_id", "station", "t"), hourly, ["station"], "t", "height_m").select("point_id", C("nearest_value").alias("height_m"))


@query(
    "a24_modes", "fx_points", doubles="place density",
    twin="""WITH RECURSIVE s AS (SELECT *, greatest(sd * pow(n, -2e-1), 1e-9) AS bw FROM (SELECT count(depth_m) AS n, stddev_samp(depth_m) AS sd, min(depth_m) AS lo, max(depth_m) AS hi FROM fx_points)), b AS (SELECT round_even(depth_m / (bw / 5), 0) AS b, count(*) AS k FROM fx_points, s GROUP BY 1),
    d AS (SELECT CAST(i AS INT) AS i, lo + (hi - lo) * i / 199e0 AS place, n, bw FROM s, (SELECT unnest(range(0, 200)) AS i)),
    g AS MATERIALIZED (SELECT i, any_value(place) AS place, sum(k * exp(-5e-1 * pow((place - b * bw / 5) / bw, 2))) / any_value(n * bw) / sqrt(2 * pi()) AS density FROM d, b GROUP BY i),
    p AS (SELECT i, density, row_number() OVER (ORDER BY density DESC, i DESC) AS r FROM (SELECT *, lag(density) OVER (ORDER BY i) AS l, lead(density) OVER (ORDER BY i) AS a FROM g) WHERE density > l AND density > a),
    kept AS (SELECT 0::BIGINT AS r, []::INT[] AS held UNION ALL SELECT p.r, CASE WHEN len(list_filter(held, lambda q: abs(q - p.i) < 10)) > 0 THEN held ELSE list_append(held, p.i) END FROM kept JOIN p ON p.r = kept.r + 1),
    h AS (SELECT unnest(held) AS i FROM kept WHERE r = (SELECT max(r) FROM kept)),
    e AS (SELECT g.i, g.place, g.density, coalesce((SELECT max(j.i) FROM g j WHERE j.i < g.i AND j.density > g.density), 0) AS a, coalesce((SELECT min(j.i) FROM g j WHERE j.i > g.i AND j.density > g.density), 199) AS z FROM g JOIN h USING (i)),
    m AS (SELECT place, density FROM e WHERE density - greatest((SELECT min(density) FROM g j WHERE j.i BETWEEN e.a AND e.i), (SELECT min(density) FROM g j WHERE j.i BETWEEN e.i AND e.z)) >= 1e-1 * (SELECT max(density) FROM g))
    SELECT CAST(count(*) OVER () AS INT) AS n_modes, count(*) OVER () > 1 AS is_bimodal, place, density FROM m""",
)
def _(p):
    return surveys.bimodality(p, "depth_m").select("n_modes", "is_bimodal", F.explode("modes").alias("m")).select("n_modes", "is_bimodal", "m.*")


@query(
    "l2_two_phase_dates", "fx_stack fx_scenes", doubles="score",
    twin=f"""WITH m AS MATERIALIZED (SELECT *, 2 * (1 - valid) + glint + (1 - deep) AS score FROM ({_METRICS})), q AS (SELECT day_no, row_number() OVER (ORDER BY round(avg(cloud), 6), day_no) AS place FROM fx_scenes WHERE day_no < 5 GROUP BY day_no),
    f AS (SELECT * FROM m JOIN q USING (day_no) WHERE place <= 3), c AS (SELECT median(nir_median) AS nm, median(red_median) AS rm, count(nir_median) AS nn, count(red_median) AS rn FROM f), d AS (SELECT median(abs(nir_median - nm)) AS nd, median(abs(red_median - rm)) AS rd FROM f, c),
    z AS (SELECT f.*, coalesce(CASE WHEN nn < 3 OR nd = 0 THEN 0 ELSE 0.6745 * (nir_median - nm) / nd END > 0.5, false) OR coalesce(CASE WHEN rn < 3 OR rd = 0 THEN 0 ELSE 0.6745 * (red_median - rm) / rd END > 0.5, false) OR coalesce(valid < 0.3, false) AS outlier FROM f, c, d),
    u AS (SELECT day_no, place, 1 AS phase, outlier, score FROM z UNION ALL SELECT day_no, place, 2, NULL, score FROM m JOIN q USING (day_no) WHERE place > 3 AND place <= 3 + 2 * (SELECT count_if(outlier) FROM z))
    SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY round(score, 9), day_no) AS INT) AS rank FROM u) WHERE rank <= 3""",
)
def _(st, s):
    from pyspark.sql import Window

    mean = s.where("day_no < 5").groupBy("day_no").agg(F.avg("cloud").alias("cloud"))  # the days that the stack has
    ranked = mean.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.round("cloud", 6), "day_no")))  # one row a date
    return pixels.two_phase_dates(ranked, st, 3, limit=0.5)


def _scene(p, px):
    t = joins.sampled_at(p, px, BANDS, 5e5, 3.4e6, 10.0).withColumn("depth_pos", F.abs("depth_m")).dropna(subset=BANDS)
    _, model = modelling.fit_depth_model(t, BANDS, "depth_pos")
    most = t.agg(*(f(b) for b in BANDS for f in (F.min, F.max)), F.max("depth_pos")).first()
    bounds = {b: (most[2 * i], most[2 * i + 1]) for i, b in enumerate(BANDS)}
    kd = optics.attenuation(C("b02"), C("b03"))
    valid = optics.water_pixel_valid(C("b02"), C("b03"), C("b04"), C("b08"), C("scl"))
    return pipelines.scene_prediction(px, model, BANDS, bounds, most[-1], kd, valid, optics.log_ratio_depth(C("b02"), C("b03")))


@query("m12_scene_prediction", "fx_points fx_pixels")
def _(p, px):
    return _scene(p, px)[0].select("cell", "score", "tree_mean_m", "tree_std_m", "depth_m", "sigma_m", "confidence")


@query("m12_scene_funnel", "fx_points fx_pixels")
def _(p, px):
    return _scene(p, px)[1]

"""Each registered query against its SQL twin in DuckDB, and a few known values."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoalspark.functions import geo, optics
from shoalspark.operators import channels, joins, modelling, pipelines, pixels, points, profiles, quantiles, selection
from shoalspark.plans.fixtures import TABLES, view
from shoalspark.plans.queries import ORACLE_SQL, QUERIES
from shoalspark.sources import files
from shoalspark.streaming.points import each_batch, windowed_counts


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def table(df):
    df = df[sorted(df.columns)]
    rows = [[None if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in r] for r in df.itertuples(index=False)]
    return list(df.columns), sorted(rows, key=str)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_twin(spark, sf_dir, duck, name):
    cols, rows = table(QUERIES[name](spark, sf_dir).toPandas())
    if name not in ORACLE_SQL:
        assert rows
        return
    other, want = table(duck.sql(ORACLE_SQL[name]).df())
    assert cols == other and len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)) for x, y in zip(a, b, strict=True)), (a, b)


def test_utm_known_values_and_round_trip(spark):
    df = spark.createDataFrame([(3.0, 0.0), (3.0, 45.0), (0.5, -33.0), (5.9, 71.3)], "lon double, lat double")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), F.lit(31))
    df = df.withColumns({"x": x, "y": y})
    lon, lat = geo.from_utm(F.col("x"), F.col("y"), F.lit(31), F.col("lat") < 0)
    rows = df.withColumns({"lon2": lon, "lat2": lat}).collect()
    assert abs(rows[0]["x"] - 500000) < 1e-6 and abs(rows[0]["y"]) < 1e-6
    assert abs(rows[1]["y"] - 4982950.400) < 1e-2
    assert all(abs(r["lon"] - r["lon2"]) < 1e-8 and abs(r["lat"] - r["lat2"]) < 1e-8 for r in rows)


def test_isotonic_fit(spark):
    df = spark.createDataFrame([(1, float(i), v) for i, v in enumerate([1.0, 3.0, 2.0, 2.0, 5.0, 4.0])], "g int, s double, v double")
    rows = profiles.isotonic(df, "g", "s", "v").orderBy("s").collect()
    assert np.allclose([r["fitted"] for r in rows], [1, 7 / 3, 7 / 3, 7 / 3, 4.5, 4.5])


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "ties"])
def test_isotonic_fit_by_runs_equals_the_whole_fit(spark, kind):
    rng = np.random.default_rng(7)
    x = np.arange(300)
    v = {"noise": rng.normal(size=300) + x / 200, "rising": x * 1.0, "falling": -x * 1.0, "ties": rng.integers(0, 3, 300) * 1.0}[kind]
    rows = [("a", int(i), float(y)) for i, y in zip(x, v, strict=True)] + [(None, int(i), float(y)) for i, y in zip(x[:50], v[:50], strict=True)] + [("a", 1000, None), ("b", 0, 2.0)]
    df = spark.createDataFrame(rows, "g string, s long, v double").repartition(5)

    def whole(y):
        blocks = []
        for m in y:
            blocks.append((m, 1))
            while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
                (p, i), (q, j) = blocks[-2:]
                blocks[-2:] = [((p * i + q * j) / (i + j), i + j)]
        return np.repeat([m for m, _ in blocks], [n for _, n in blocks])

    for up in (True, False):
        got = profiles.isotonic(df, "g", "s", "v", up, run=64).orderBy("s").collect()
        sign = 1 if up else -1
        assert len(got) == len(rows)
        assert np.allclose([r["fitted"] for r in got if r["g"] == "a" and r["v"] is not None], sign * whole(sign * v))
        assert np.allclose([r["fitted"] for r in got if r["g"] is None], sign * whole(sign * v[:50]))
        assert [r["fitted"] for r in got if r["v"] is None] == [None] and [r["fitted"] for r in got if r["g"] == "b"] == [2.0]
    assert profiles.isotonic(df.where("false"), "g", "s", "v").collect() == []


def test_exact_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v), int(k)) for g, n in (("a", 997), (None, 40), ("b", 1), ("c", 2)) for v, k in zip(rng.normal(size=n).round(2), rng.integers(0, 3, n), strict=True)]
    rows += [("a", 0.5, 1)] * 500 + [("d", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, k int").repartition(7)
    ps = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    wanted = {f"{c}{i}": (c, p) for c in "vk" for i, p in enumerate(ps)}
    want = [F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in wanted.items()]
    values = {"v": F.col("v"), "k": F.col("k")}
    assert np.allclose(quantiles.exact_quantiles(df, values, wanted).collect(), df.agg(*want).collect())
    got = {r["g"]: r[1:] for r in quantiles.exact_quantiles(df, values, wanted, ("g",)).collect()}
    for r in df.where("g is null or g <> 'd'").groupBy("g").agg(*want).collect():
        assert np.allclose(got.pop(r["g"]), r[1:])
    assert not got  # a group without values has no row
    stats = df.groupBy("g").agg(F.count("*").alias("n"))
    joined = {r["g"]: r for r in quantiles.with_quantiles(stats, quantiles.exact_quantiles(df, values, wanted, ("g",)), ("g",)).collect()}
    assert len(joined) == 5 and joined["d"]["v3"] is None and joined[None]["n"] == 40 and joined[None]["v3"] is not None
    none = quantiles.exact_quantiles(df.where("false"), values, wanted).collect()
    assert len(none) == 1 and set(none[0]) == {None}


def test_edges_and_growth_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    m = rng.random((14, 17)) < 0.3
    m[3, 3] = True
    df = spark.createDataFrame([(i, j, bool(m[i, j])) for i in range(14) for j in range(17)], "prow int, pcol int, m boolean")
    cells = [(i, j) for i in range(14) for j in range(17)]
    on = [c for c in cells if m[c]]
    for n in (0, 1, 3):
        want = {c for c in cells if any(abs(c[0] - o[0]) + abs(c[1] - o[1]) <= n for o in on)}
        assert {(r["prow"], r["pcol"]) for r in pixels.dilated(df, "m", n).where("m").collect()} == want
    off = [c for c in cells if not m[c] and any((c[0] + a, c[1] + b) in set(on) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))]
    for cap in (5.0, 25.0, 40.0):
        got = {(r["prow"], r["pcol"]): r["edge_m"] for r in pixels.edge_distance(df, "m", cap).collect()}
        assert got.keys() == set(on)
        for c in on:
            d = min(10 * math.hypot(c[0] - o[0], c[1] - o[1]) for o in off)
            assert math.isclose(got[c], d if d <= cap else cap), (c, got[c], d)


def test_source_cap_takes_the_first_of_each_source(spark):
    rows = [(i % 500, "a") for i in range(900)] + [(i, "b") for i in range(20)] + [(i, None) for i in range(60)] + [(77, "c")] * 80
    df = spark.createDataFrame(rows, "point_id long, source string")
    got = points.source_capped(df, 50).collect()
    key = lambda i: ((i * 7919 + 42) % 10007, i)
    for s in ("a", "b", None, "c"):
        want = sorted((i for i, t in rows if t == s), key=key)[:50]
        assert sorted(r["point_id"] for r in got if r["source"] == s) == sorted(want)


def test_planar_shift_recovers_a_plane(spark):
    df = spark.range(500).selectExpr("id % 25 * 1e1 as x", "floor(id / 25) * 1e1 as y").withColumn("r", 2 + 0.01 * F.col("x") - 0.02 * F.col("y") + F.when(F.col("x") == 30, 9.0).otherwise(0.0))
    assert np.allclose(modelling.planar_shift(df, "r"), (2, 0.01, -0.02), atol=0.02)


def test_nearest_neighbours_equal_brute_force_under_any_partitioning(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random((60, 2)) * 1000, rng.random((200, 2)) * 300
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "q long, x double, y double")
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "r long, rx double, ry double")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    want = {(q, int(r)) for q in range(60) for r in np.argsort(d[q], kind="stable")[:5]}
    for n in (1, 16):
        got = joins.knn(left.repartition(n), right.repartition(n), 5, 10.0, "q", "r").select("q", "r").collect()
        assert {tuple(r) for r in got} == want


def test_collocation_ignores_order(spark, sf_dir):
    p = view(spark, sf_dir, "fx_points")
    one = points.fused_training_table(p).select("point_id", "depth_m", "source")
    two = points.fused_training_table(p.repartition(13)).select("point_id", "depth_m", "source")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_survey_files_flip_signs_and_drop_outliers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Lon,Lat,Depth\n" + "\n".join(f"{i},{i},{5 + i % 3}" for i in range(20)) + "\n3,3,900\n")
    (tmp_path / "b.csv").write_text("Lon,Lat,Depth\n" + "\n".join(f"{i},{i},-{5 + i % 3}" for i in range(20)) + "\n")
    rows = files.survey_points(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv")]).collect()
    assert len(rows) == 40 and all(r["depth_m"] < 0 for r in rows)
    assert files.soundings(spark, str(tmp_path)).count() == 41
    assert files.optional_csv(spark, str(tmp_path / "none.csv"), "Lon double").count() == files.optional_csv(spark, None, "Lon double").count() == 0
    assert files.optional_csv(spark, str(tmp_path / "a.csv"), "Lon double, Lat double, Depth double").count() == 21
    (tmp_path / "g.txt").write_text("# note\nsite_no\twidth_ft\tstage_ft\n5s\t12n\t12n\n01\t10\t2\n")
    assert files.gage_table(spark, str(tmp_path / "g.txt")).count() == 1
    (tmp_path / "s.json").write_text('{"id": "S2A_T16RDU_x", "properties": {"datetime": "2020-05-01T16:00:00Z", "eo:cloud_cover": 3.5, "view:sun_elevation": 60}, "assets": {"blue": {"href": "u"}}}')
    scene = files.scene_catalog(spark, str(tmp_path / "s.json")).withColumn("href", files.band_href(F.col("assets"), ["B02", "blue"])).first()
    assert (scene["tile"], scene["cloud"], scene["sun_zenith"], scene["href"]) == ("16RDU", 3.5, 30.0, "u")


def test_sinks_round_trip(spark, tmp_path, sf_dir):
    px = view(spark, sf_dir, "fx_pixels").select("prow", "pcol", F.col("b02").alias("depth"))
    files.write_grid(px, str(tmp_path / "grid"), 16, units="m")
    assert spark.read.parquet(str(tmp_path / "grid")).where("tile_r = 0").count() == px.where("prow < 16").count()
    files.write_training(modelling.stratified_split(view(spark, sf_dir, "fx_points"), "point_id", "depth_m"), str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t")).groupBy("split").count().collect()
    n = {r[0]: r[1] for r in t}
    assert n["all"] == n["train"] + n["test"]


def test_streams(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = each_batch(stream, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == events.count()
    w = windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == events.count()


def test_nearest_neighbours_within_groups(spark):
    rng = np.random.default_rng(6)
    a, b = rng.random((40, 2)) * 3000, rng.random((90, 2)) * 200
    left = spark.createDataFrame([(i, i % 3, float(x), float(y)) for i, (x, y) in enumerate(a)], "q long, g long, x double, y double")
    right = spark.createDataFrame([(i, i % 3, float(x), float(y)) for i, (x, y) in enumerate(b)], "r long, g long, rx double, ry double")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    d[np.arange(40)[:, None] % 3 != np.arange(90)[None] % 3] = np.inf
    want = {(q, int(r)) for q in range(40) for r in np.argsort(d[q], kind="stable")[:4]}
    assert {tuple(r) for r in joins.knn(left, right, 4, 10.0, "q", "r", by=("g",)).select("q", "r").collect()} == want
    few = joins.knn(left, right.where("r < 6"), 4, 10.0, "q", "r", by=("g",))
    assert few.count() == 80 and joins.knn(left, right.drop("g").where("r < 0"), 4, 10.0, "q", "r").count() == 0


def test_line_residual_filter_drops_what_lies_off_the_line(spark):
    df = spark.range(600).selectExpr("id as k", "id % 50 * 1e-1 as i", "2 + 3 * (id % 50 * 1e-1) + (id % 7 - 3) * 1e-2 + if(id % 9 = 0, 3e0, 0e0) as z")
    kept = {r[0] for r in selection.line_residual_filter(df, "k", "i", "z").select("k").collect()}
    assert kept == {k for k in range(600) if k % 9}
    assert selection.line_residual_filter(df.where("k < 100"), "k", "i", "z").count() == 100


def test_endmembers_equal_numpy(spark, sf_dir):
    bands = ["b02", "b03", "b04"]
    px = view(spark, sf_dir, "fx_pixels")
    data = px.select(bands).toPandas().to_numpy()
    mean, axis = data.mean(axis=0), np.linalg.eigh(np.cov(data.T))[1][:, -1]
    axis = axis if axis[0] >= 0 else -axis
    ends = np.percentile((data - mean) @ axis, [95, 5])
    got = {r["band"]: (r["sand"], r["grass"]) for r in selection.bottom_endmembers(px, bands).collect()}
    for i, b in enumerate(bands):
        assert np.allclose(got[b], np.clip(ends * axis[i] + mean[i], 0, 1))
    assert selection.bottom_endmembers(px.limit(3), bands) is None


def test_component_fill_equals_brute_force(spark, sf_dir):
    px = view(spark, sf_dir, "fx_pixels").withColumn("depth_m", F.when((F.col("scl").between(4, 8)) & (F.col("prow") % 13 > 0), -F.col("b03") * 100))
    pts = view(spark, sf_dir, "fx_points")
    got = {r["cell"]: r for r in channels.component_fill(px, pts, 5e5, 3.4e6, 10.0, least=5).collect()}
    cells = px.where("depth_m is not null").toPandas().set_index(["prow", "pcol"])
    label = {}
    for start in sorted(cells.index):
        todo = [start] if start not in label else []
        while todo:
            at = todo.pop()
            if at in cells.index and at not in label:
                label[at] = start[0] * 2**31 + start[1]
                todo += [(at[0] + i, at[1] + j) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    assert {r["cell"]: r["component_id"] for r in got.values()} == {int(cells.loc[at, "cell"]): v for at, v in label.items()}
    p = pts.toPandas()
    p["at"] = list(zip(np.floor((3.4e6 - p.y) / 10).astype(int), np.floor((p.x - 5e5) / 10).astype(int), strict=True))
    p = p[p["at"].isin(label)]
    p["g"], p["res"] = p["at"].map(label), p.depth_m - p["at"].map(lambda a: cells.loc[a, "depth_m"])
    filled = 0
    for at, g in label.items():
        c, mine = cells.loc[at], p[p.g == g]
        want = c.depth_m
        if len(mine) >= 5:
            lo, hi = mine.res.mean() - 4 * mine.res.std(ddof=0), mine.res.mean() + 4 * mine.res.std(ddof=0)
            d = np.hypot(mine.x - c.x, mine.y - c.y).to_numpy()
            near = np.lexsort((mine.point_id, d))[:8]
            w = (d[near] + 1e-6) ** -2.0
            want += (w * mine.res.clip(lo, hi).clip(-10, 10).to_numpy()[near]).sum() / w.sum()
            filled += 1
        assert math.isclose(got[int(c.cell)]["depth"], want, rel_tol=1e-6), at
    assert filled


def test_river_depths_rest_on_the_best_source(spark):
    xs = spark.createDataFrame([(i, 1, i * 10.0, 100.0, 20.0, 19.0, 7 if i < 6 else 8) for i in range(9)], "xs_id long, river_id int, s_center_m double, width_m double, wse_m double, bank_min_m double, site_no int")
    m = spark.createDataFrame([(7, 300.0 + i, 5.0 + i * 0.1, 500.0 + i, 3000.0) for i in range(20)], "site_no int, width_ft double, stage_ft double, discharge_cfs double, area_sqft double")
    snd = spark.createDataFrame([(0, 4, 6.5)], "xs_id long, n long, median_m double")
    rows = {r["xs_id"]: r for r in pipelines.river_depths(xs, m, snd).collect()}
    assert [rows[i]["depth_source"] for i in range(9)] == ["soundings"] + ["gage"] * 5 + ["prior"] * 3
    assert rows[0]["depth_raw_m"] == 6.5 and math.isclose(rows[8]["depth_raw_m"], 1.8)
    assert all(r["bed_m"] <= 18.95 and math.isclose(r["bed_m"], min(20 - r["depth_m"], 18.95)) for r in rows.values())
    assert {r["depth_source"] for r in pipelines.river_depths(xs, m).collect()} == {"gage", "prior"}


def test_composite_takes_clear_values_of_the_chosen_dates(spark):
    scenes = spark.createDataFrame([("A", 0, 5.0), ("A", 1, 6.0), ("B", 1, 7.0), ("A", 2, 90.0)], "tile string, day_no int, cloud double")
    stack = spark.createDataFrame([(0, c, d, 0.1 * (d + 1), 0.1, 0.1, 0.01, 8 if (c, d) == (0, 0) else 6) for c in range(4) for d in range(3)], "prow int, pcol int, day_no int, b02 double, b03 double, b04 double, b08 double, scl int")
    got = {r["pcol"]: (round(r["b02"], 6), r["clear_dates"]) for r in pipelines.optical_composite(scenes, stack, ["b02"], dates=2).collect()}
    assert got == {0: (0.2, 1), 1: (0.15, 2), 2: (0.15, 2), 3: (0.15, 2)}


def test_log_ratio_depth_divides_last_as_its_twins_do(spark):
    rows = [(b / 1000.0,) for b in range(20, 120)]
    got = spark.createDataFrame(rows, "b double").select("b", optics.log_ratio_depth(F.col("b"), F.col("b"), -22.0, 30.0).alias("z"), F.ln(1000.0 * F.col("b")).alias("l")).collect()
    assert all(r["z"] == 30.0 * r["l"] / r["l"] - 22.0 for r in got)

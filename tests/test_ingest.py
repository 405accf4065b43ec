"""Operators without an SQL twin against brute force, and edge cases of filters and fixes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalspark.functions import hydraulics
from shoalspark.operators import filters, ingest, joins, modelling, pixels, points, profiles, quality
from shoalspark.plans.fixtures import view
from shoalspark.sources import files


def test_transects_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    line = [(i * 10.0, 5 + 0.2 * (i % 3)) for i in range(40)]
    cloud = (rng.random((60, 2)) * 100 + [0, 3000]).tolist()
    xy = np.array(line + cloud + [(0.0, 5.0)] * 3)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "point_id long, x double, y double")
    got = {r["point_id"]: r["is_transect"] for r in points.transects(df).collect()}
    for i, p in enumerate(xy):
        others = [j for j in sorted(range(len(xy)), key=lambda j: (np.hypot(*(xy[j] - p)), j))[:20] if j != i][:19]
        v = xy[others] - p
        main = np.linalg.svd(v)[2][0]
        share = ((np.abs(v @ main) > 0.9 * np.linalg.norm(v, axis=1)) & (np.linalg.norm(v, axis=1) > 0)).mean()
        assert got[i] == bool(share > 0.7), i
    assert got[20] and not any(got[i] for i in range(40, 100))
    assert not points.transects(df.where("point_id < 5")).where("is_transect").count()


def test_tree_spread_has_the_forests_mean(spark, sf_dir):
    bands = ["b02", "b03"]
    px = view(spark, sf_dir, "fx_pixels").select("cell", *bands, (F.col("b03") * 50 + F.col("b02")).alias("depth"))
    assembler, model = modelling.fit_depth_model(px, bands, "depth", trees=5, depth=4)
    rows = modelling.tree_spread(model, model.transform(assembler.transform(px))).collect()
    each = [t.predict for t in model.trees]
    assert all(math.isclose(r["tree_mean_m"], r["predicted_m"], abs_tol=1e-9) for r in rows)
    for r in rows[:20]:
        assert math.isclose(r["tree_std_m"], np.std([p(r["features"]) for p in each]), abs_tol=1e-9)


def test_classified_product_feeds_the_classified_scan(spark, sf_dir):
    product = ingest.classified_product(view(spark, sf_dir, "fx_photons"), 5e-3, 0.25)
    rows = ingest.classified_scan(product).collect()
    assert rows and len(rows) == product.count() and all(r["depth_m"] == -abs(r["surface_h"] - r["ortho_h"]) and r["ortho_h"] < r["surface_h"] for r in rows)


def test_scans_drop_what_is_not_finite(spark):
    raw = spark.createDataFrame([(1, 1, 30.0, -88.0, 1.0, 4), (2, 0, 30.0, float("nan"), 1.0, 4), (3, 21, None, -88.0, 1.0, 4), (1, 5, 30.0, -88.0, float("inf"), 4), (2, 9, 30.0, -88.0, 1.0, 1)], "laser int, orient int, latitude double, longitude double, photon_height double, conf int")
    assert [r["beam"] for r in ingest.photon_scan(raw).orderBy("laser").collect()] == ["gt1r", "gt2l"]
    assert ingest.photon_scan(raw, (-89, -87, 29, 31), 3).count() == 1


def test_areas_that_cannot_be_read_are_null(spark):
    df = spark.createDataFrame([("-90/-80/20/30",), ("1/2/3",), ("a/b/c/d",), (None,)], "t string").select(*(c.alias(n) for n, c in ingest.parsed_area(F.col("t"), 0.1).items()))
    assert [tuple(r) for r in df.collect()] == [(-91.0, -79.0, 19.0, 31.0)] + [(None,) * 4] * 3


def test_clipping_cuts_where_a_line_leaves_and_comes_back(spark):
    lines = spark.createDataFrame([("a", [(-5.0, 5.0), (5.0, 5.0), (5.0, 15.0), (7.0, 15.0), (7.0, 1.0)]), ("b", [(20.0, 0.0), (30.0, 0.0)]), ("c", [(1.0, 1.0)]), ("d", [(0.0, 0.0), (0.0, 0.0), (0.0, 3.0)])], "river_id string, coords array<struct<x double, y double>>")
    got = {r["river_id"]: tuple(r)[1:] for r in ingest.clipped_lines(lines, (0.0, 10.0, 0.0, 10.0)).collect()}
    assert got == {"a": (19.0, 3, 2), "d": (3.0, 1, 1)}


def test_masks_without_values_or_of_one_value(spark):
    schema = "point_id long, source string, mask double, land double, clear_water double"
    df = spark.createDataFrame([(1, "atl03", None, None, 1.0), (2, "atl03", 1.0, 1.0, 1.0), (3, "extra_xyz", 1.0, 1.0, None), (4, "atl24", 1.0, 1.0, 0.0)], schema)
    ids = lambda x: sorted(r["point_id"] for r in x.collect())
    assert ids(filters.mask_filtered(df)) == [2, 3, 4] and ids(filters.mask_filtered(df, kind="land_binary")) == []
    assert ids(filters.mask_filtered(df.where("mask is null"))) == []
    assert ids(filters.environment_filtered(df)) == [1, 3]  # one value alone is judged by land_max
    assert ids(filters.environment_filtered(df, nodata_is_water=False, least_clear=None)) == [3]


def test_no_division_by_nothing(spark):
    flat = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 9.0)], "point_id long, x double, y double")
    grid = modelling.coverage_grid(flat, 2, 1).where("n > 0").collect()
    assert {(r["gr"], r["gc"], r["n"]) for r in grid} == {(0, 0, 1), (1, 0, 1)}
    tiles = spark.createDataFrame([(0, 0, 1.0, 0.0, 6), (0, 1, 2.0, 1.0, 6)], "prow int, pcol int, v double, w double, scl int")
    assert {(r["pcol"], r["v"]) for r in pixels.weighted_mosaic(tiles, "v", "w").collect()} == {(0, None), (1, 2.0)}
    none = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "source string, sample_weight double")
    assert {r["effective_share"] for r in points.composition(none).collect()} == {None}
    empty = quality.prediction_sanity(spark.createDataFrame([(None,)], "d double"), "d", (-9.0, -1.0)).first()
    assert (empty["n_total"], empty["n_finite"], empty["status"], empty["messages"]) == (1, 0, "error", "no finite value")


def test_stations_start_at_the_southmost_leaf(spark):
    edges = spark.createDataFrame([(1, 2, 10.0), (2, 3, 5.0), (2, 4, 1.0), (4, 5, 2.0), (5, 3, 1.0), (8, 9, 3.0)], "from_node long, to_node long, length_m double")
    nodes = spark.createDataFrame([(1, 4.0), (2, 0.0), (3, 1.0), (4, 9.0), (5, 9.0), (8, 2.0), (9, 2.0)], "node long, y double")
    rows = {r["node"]: r["s_m"] for r in profiles.stationed(edges, profiles.components(edges), nodes).collect()}
    assert rows == {1: 0.0, 2: 10.0, 3: 14.0, 4: 11.0, 5: 13.0, 8: 0.0, 9: 3.0}  # 1 is the one leaf of its component


def test_unknown_beds_and_regions_say_nothing(spark):
    df = spark.createDataFrame([(None, None), ("mud", "nowhere"), ("Mountain Cobble", "great-plains")], "bed string, region string")
    got = [r[0] for r in df.select(hydraulics.roughness(F.col("bed"), F.lit(3), F.lit(1.0), F.col("region"))["n"]).collect()]
    assert np.allclose(got, [0.035, 0.035, (0.050 + 0.028) / 2])


def test_fusion_takes_the_fullest_grid_as_template(spark):
    full = spark.createDataFrame([(r, c, 1.0) for r in range(4) for c in range(4)], "prow int, pcol int, depth double")
    coarse = spark.createDataFrame([(0, 0, 5.0), (1, 1, None)], "prow int, pcol int, depth double")
    cells, stats = pixels.fused_sources({"coarse": coarse, "full": full}, {"coarse": (0.0, 40.0, 20.0), "full": (0.0, 40.0, 10.0)}, lambda c: pixels.fused_priority(c, [("coarse", 3), ("full", 1)]))
    assert {(r["prow"], r["pcol"]) for r in cells.where("code = 3").collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert {(r["code"], r["n"]) for r in stats.collect()} == {(1, 12), (3, 4)} and cells.first()["template"] == "full"


def test_collocation_reads_its_pairs_once(spark, sf_dir):
    p = view(spark, sf_dir, "fx_points")
    plan = joins.collocated(p.where("source = 'atl03'"), p.where("source = 'atl24'"))._jdf.queryExecution().toString()
    assert plan.count("flatten(transform") == 0  # the radius join lies before the checkpoint


def test_files_of_different_headers_are_read_by_name(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "one.csv").write_text("Lon,Lat,Depth\n-88,30,1\n-88,30,2\n-88,30,1.5\n-88,30,400\n")
    (tmp_path / "two.csv").write_text("depth,lat,lon\n-7.5,30.3,-88.2\n-7.7,30.4,-88.3\n")
    (tmp_path / "three.csv").write_text("sigma,z,y,x\n0.5,-3,2,1\n")
    paths = [str(tmp_path / "a b" / "one.csv"), str(tmp_path / "two.csv")]
    got = {(r["longitude"], r["latitude"], r["depth_m"]) for r in files.survey_points(spark, paths).collect()}
    assert got == {(-88.0, 30.0, -1.0), (-88.0, 30.0, -2.0), (-88.0, 30.0, -1.5), (-88.2, 30.3, -7.5), (-88.3, 30.4, -7.7)}
    hq = {(r["x"], r["z"], r["uncertainty"]) for r in files.high_quality_points(spark, [*paths, str(tmp_path / "three.csv")]).collect()}
    assert (1.0, -3.0, 0.5) in hq and (-88.2, -7.5, None) in hq and len(hq) == 7
    assert files.soundings(spark, str(tmp_path)).count() == 7
    (tmp_path / "w1.csv").write_text("site,width_ft,stage_ft\ns1,10,20\n")
    (tmp_path / "w2.csv").write_text("stage_m,site,width_m\n2,s2,3\n")
    rows = sorted(tuple(r) for r in files.width_stage(spark, [str(tmp_path / "w1.csv"), str(tmp_path / "w2.csv")]).collect())
    assert rows == [("s1", pytest.approx(3.048), pytest.approx(6.096)), ("s2", 3.0, 2.0)]

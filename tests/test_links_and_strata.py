"""Links, widened boxes, gated slopes, scene catalogs and exact quotas against plain Python."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalspark.operators import filters, links, modelling, pixels, profiles, quality, surveys
from shoalspark.sources import files


def test_split_equals_percent_rank_with_ties_rare_strata_and_nulls(spark):
    rows = [(i % 150, float(i % 3 if i % 97 else 50 + i)) for i in range(1500)] + [(7, None), (8, None)]
    df = spark.createDataFrame(rows, "point_id long, depth_m double")
    got = modelling.stratified_split(df, "point_id", "depth_m", 20, 0.2).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes.setdefault(r["stratum"], []).append((r["point_id"] * 7919 + 42) % 10007)
    for r in got:
        keys = sizes[r["stratum"]]
        rank = sum(k < (r["point_id"] * 7919 + 42) % 10007 for k in keys)
        assert r["is_test"] == ((rank / (len(keys) - 1) if len(keys) > 1 else 0.0) < 0.2)
    # a value above all cuts by itself joins the largest stratum
    lone = spark.createDataFrame([(i, 1.0) for i in range(50)] + [(99, 9.0)], "point_id long, depth_m double")
    assert {r["stratum"] for r in modelling.stratified_split(lone, "point_id", "depth_m").collect()} == {0}
    assert modelling.stratified_split(df.limit(0), "point_id", "depth_m").count() == 0


@pytest.mark.parametrize("target", [0, 3, 7, 40, 399, 400, 1000])
def test_quotas_meet_the_target_exactly(spark, target):
    cells = [(i, i // 20, i % 20, float(i % 7 if i < 150 else 0)) for i in range(400)] + [(1000, 0, 0, None)]
    df = spark.createDataFrame(cells, "cell long, prow int, pcol int, depth double")
    got = pixels.stratified_cells(df, "depth", target).collect()
    assert len({r["cell"] for r in got}) == len(got) == min(target, 400)
    strata = {(int(c[3]), c[1] // 10, c[2] // 10) for c in cells[:-1]}
    if target >= len(strata):
        assert {(int(r["depth"]), r["prow"] // 10, r["pcol"] // 10) for r in got} == strata
    assert pixels.stratified_cells(df.where("cell < 0"), "depth", target).count() == 0


def test_scene_catalog_of_odd_items(spark, tmp_path):
    items = [
        {"id": "a", "properties": {"datetime": " ", "end_datetime": "2020-05-01T16:00:00Z", "eo:cloud_cover": "x", "s2:mgrs_tile": "none", "mgrs_tile": " 16rdu ", "s2:relative_orbit": "97", "view:sun_elevation": "50"}},
        {"id": "S2_R012_T15TXM_z", "properties": {"product": "GRID 14ABC", "n": 3}},
        {"id": "x 15TXM y", "properties": None, "assets": None},
        {"id": None, "properties": {"sat:relative_orbit": "?", "relative_orbit": 8.0, "view:off_nadir": 2}},
    ]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, items)))
    got = files.scene_catalog(spark, str(tmp_path)).select("tile", "orbit", "cloud", "sun_zenith", "view_zenith", F.col("dt").isNotNull()).collect()
    assert [tuple(r) for r in got] == [("16RDU", "097", 100.0, 40.0, None, True), ("14ABC", "012", 100.0, None, None, False), ("15TXM", "UNK", 100.0, None, None, False), ("UNK", "008", 100.0, None, 2.0, False)]


def test_links_keep_nearer_ones_and_fall_back(spark):
    xs = spark.createDataFrame([(1, 0.0, 0.0, "a", "old", 1.0), (2, 0.0, 0.0, "a", "old", 99.0), (3, 0.0, 0.0, "z", " NaN ", 0.0), (4, 0.0, 0.0, None, None, None), (5, None, 0.0, "a", "old", 5.0), (6, 0.0, 0.0, "a", "old", float("inf"))], "xs_id long, x double, y double, river_id string, gage_site string, gage_m double")
    gages = spark.createDataFrame([("near", 3.0, 4.0, "b"), ("far", 30.0, 40.0, "a"), ("lost", 3.0, 4.0, None)], "site_no string, sx double, sy double, river_id string")
    got = {r["xs_id"]: (r["gage_site"], r["gage_m"]) for r in links.gage_links(xs, gages, 2.0).collect()}
    assert got == {1: ("old", 1.0), 2: ("far", 50.0), 3: ("lost", 5.0), 4: ("lost", 5.0), 5: ("old", 5.0), 6: ("far", 50.0)}
    none = links.gage_links(xs.drop("gage_site", "gage_m"), gages.limit(0), 2.0).collect()
    assert len(none) == 6 and all(r["gage_site"] is None for r in none)


def test_box_widens_only_when_empty(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, None, 0.5)], "id long, longitude double, latitude double")
    ids = lambda *a: {r["id"] for r in links.in_area(p, *a).collect()}
    assert ids((0.0, 1.0, 0.0, 1.0), 1.0) == {1} and ids((2.0, 3.0, 0.0, 1.0), 0.6) == {2} and ids((2.0, 3.0, 0.0, 1.0)) == set()


def test_months_and_complete_dates(spark):
    s = spark.createDataFrame([("2021-03-01", "a", 5.0), ("2021-03-01", "b", 15.0), ("2021-03-02", "a", 0.0), ("2021-08-01", "a", 0.0), ("2021-08-01", "b", 0.0)], "date string, tile string, cloud double").withColumn("date", F.to_date("date"))
    w = F.when(F.col("tile") == "a", 3.0).otherwise(1.0)
    assert [(str(r["date"]), r["score"]) for r in links.ranked_dates(s, w, (3,)).collect()] == [("2021-03-02", 0.0), ("2021-03-01", 7.5)]
    assert [str(r["date"]) for r in links.ranked_dates(s, w, every_tile=True).collect()] == ["2021-08-01", "2021-03-01"]


def test_gated_slope_is_the_gradient_of_the_medians(spark):
    rng = np.random.default_rng(3)
    s = np.cumsum(rng.uniform(5, 40, 60))
    down, flat = 50 - s * 2e-3 + rng.normal(0, 0.05, 60), rng.normal(0, 0.05, 60)
    rows = [("down", float(a), float(v)) for a, v in zip(s, down, strict=True)] + [("flat", float(a), float(v)) for a, v in zip(s, flat, strict=True)] + [("few", float(i), float(i)) for i in range(9)] + [("one", 5.0, float(i)) for i in range(20)]
    df = spark.createDataFrame([*rows, ("down", None, 1.0), ("down", 1.0, float("nan"))], "g string, s double, v double")
    got = profiles.gated_slope(df, "g", "s", "v").collect()
    assert len(got) == len(rows) + 2 and all(r["slope"] is None for r in got if r["g"] != "down" or r["s"] is None or math.isnan(r["v"]))
    med = np.array([np.median(down[max(0, i - 3) : i + 4]) for i in range(60)])
    want = np.clip(np.abs(np.gradient(med, s)), 0, 0.05)
    ours = sorted((r["s"], r["slope"]) for r in got if r["g"] == "down" and r["slope"] is not None)
    assert np.allclose([v for _, v in ours], want, atol=1e-12)


def test_validity_grows_along_rows_and_columns(spark):
    px = spark.createDataFrame([(r, c, 9 if (r, c) == (3, 3) else None if (r, c) == (0, 0) else 6) for r in range(7) for c in range(7)], "prow int, pcol int, scl int")
    for grow in (0, 1, 2):
        got = {(r["prow"], r["pcol"]) for r in filters.scene_validity(px, grow=grow).where("not valid").collect()}
        assert got == {(r, c) for r in range(7) for c in range(7) if abs(r - 3) + abs(c - 3) <= grow}


def test_messages_of_missing_and_impossible_values(spark):
    df = spark.createDataFrame([(None, "2020-01-01", None), ("2020-02-30", "2020-03-01", "51"), ("2020-01-01", "2020-02-01", "AUTO")], "a string, b string, d string")
    dates, depths = quality.date_messages(F.col("a"), F.col("b"), F.lit("2024-01-01").cast("date")), quality.depth_messages(F.col("d"), F.lit(None).cast("double"), F.lit(1.0))
    got = df.select(dates.alias("x"), depths.alias("z")).collect()
    assert [r["x"] for r in got] == [["error: start isn't a date"], ["error: start isn't a date"], []] and [len(r["z"]) for r in got] == [0, 1, 0]


def test_gaps_reach_the_deepest_point(spark):
    df = spark.createDataFrame([(-float(d),) for d in [0.5, 1.5, 3.2, 41.7] for _ in range(10)] + [(None,), (float("nan"),)], "depth_m double")
    assert sorted(map(tuple, surveys.depth_gaps(df).collect())) == [(2, 3), (4, 41)]
    assert list(map(tuple, surveys.depth_gaps(df.limit(0), deepest=5).collect())) == [(0, 5)]

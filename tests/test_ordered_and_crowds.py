"""Long ordered groups by runs, and crowded places by descent, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shoalspark.operators import joins, ordered, profiles, sampling


@pytest.mark.parametrize(("run", "reach"), [(4, 3), (7, 1), (4096, 2)])
def test_runs_give_what_whole_windows_give(spark, run, reach):
    rng = np.random.default_rng(run)
    rows = [(g, int(i), None if rng.random() < 0.1 else float(rng.integers(-50, 50))) for g, n in (("a", 200), ("b", 1), (None, 9), ("c", run * 3)) for i in rng.permutation(n)]
    df = spark.createDataFrame(rows, "g string, o int, v double").repartition(5)
    rows = ordered.placed(df, ["g"], ["o"], run)
    got = ordered.windowed(rows, reach, lambda r, w: r.withColumns({"before": F.lag("v", reach).over(w), "around": F.sum("v").over(w.rowsBetween(-reach, reach))}), run)
    got = ordered.running(got, total=("sum", F.col("v")), top=("max", F.col("v")), n=("count", F.col("v"))).toPandas()
    w = Window.partitionBy("g").orderBy("o")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("g", "o", F.row_number().over(w).alias("i"), F.lag("v", reach).over(w).alias("before"), F.sum("v").over(w.rowsBetween(-reach, reach)).alias("around"), F.sum("v").over(up).alias("total"), F.max("v").over(up).alias("top"), F.count("v").over(up).alias("n")).toPandas()
    assert (got["_i"] // run == got["_run"]).all()
    got = got.assign(i=got["_i"] + 1)[list(want.columns)]
    key = lambda d: d.fillna({"g": "-"}).sort_values(["g", "o"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(key(got), key(want), check_dtype=False)


def test_a_window_beyond_a_run_is_refused(spark):
    with pytest.raises(ValueError):
        ordered.windowed(ordered.placed(spark.createDataFrame([("a", 1)], "g string, o int"), ["g"], ["o"], 4), 4, lambda r, w: r, 4)


def test_profile_functions_over_a_river_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RUN", 16)
    rng = np.random.default_rng(5)
    rows = [(1, float(i), float(rng.integers(0, 40))) for i in range(150)] + [(2, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "river_id int, s double, d double")
    got = profiles.monotone_depth(df, "river_id", "s", "d", 0.25).toPandas().sort_values(["river_id", "s"])
    deep, last = [], -1e9
    for r, _, d in rows:
        last = max(d, last - 0.25) if r == 1 else d
        deep.append(last)
    assert np.allclose(got["adjusted_m"], deep)


def nearest(left, right, radius):
    """The nearest right row (the lesser index of equals) and its distance, or -1."""
    best, far = np.empty(len(left), int), np.empty(len(left))
    for i in range(0, len(left), 500):
        d = np.sqrt((left[i : i + 500, :1] - right[:, 0]) ** 2 + (left[i : i + 500, 1:] - right[:, 1]) ** 2)
        best[i : i + 500], far[i : i + 500] = d.argmin(axis=1), d.min(axis=1)
    return np.where(far <= radius, best, -1), far


def crowd(n, rng):
    """Most places in one cell of the radius, some of them in a far smaller spot, many at one place."""
    spread = rng.random((n, 2)) * 9
    spread[: n // 3] = 4 + rng.random((n // 3, 2)) * 1e-4
    spread[n // 3 : n // 2] = [7.5, 2.5]
    return np.vstack([spread, rng.random((50, 2)) * 400])


def frame(spark, at, prefix=""):
    rows = pd.DataFrame({"i": np.arange(len(at)), f"{prefix}x": at[:, 0], f"{prefix}y": at[:, 1]})
    return spark.createDataFrame(rows)


def test_nearest_and_any_within_a_crowd(spark):
    rng = np.random.default_rng(6)
    left, right = crowd(6000, rng), crowd(5000, rng)
    best, far = nearest(left, right, 10.0)
    a, b = frame(spark, left), frame(spark, right, "r").withColumnRenamed("i", "ref")
    got = {r["i"]: (r["ref"], r["dist"]) for r in joins.nearest_within(a, b, 10.0, "i", "ref").collect()}
    assert set(got) == set(np.flatnonzero(best >= 0).tolist())
    assert all(got[i][0] == best[i] and abs(got[i][1] - far[i]) < 1e-12 for i in got)
    some = {r["i"] for r in joins.any_within(a, b, 10.0, ["i"]).collect()}
    assert some == set(got)
    assert joins.any_within(a, b.limit(0), 10.0, ["i"]).count() == 0


def test_many_nearest_in_a_crowd_and_no_place(spark):
    rng = np.random.default_rng(7)
    left, right = crowd(300, rng), crowd(4000, rng)
    a = frame(spark, left).unionByName(spark.createDataFrame([(-1, None, 1.0)], "i long, x double, y double"))
    b = frame(spark, right, "r").withColumnRenamed("i", "ref").unionByName(spark.createDataFrame([(-5, 1.0, None)], "ref long, rx double, ry double"))
    got = joins.knn(a, b, 5, 10.0, "i", "ref").toPandas()
    assert set(got["i"]) == set(range(len(left)))
    for i, g in got.groupby("i"):
        d = np.sqrt((left[i, 0] - right[:, 0]) ** 2 + (left[i, 1] - right[:, 1]) ** 2)
        want = np.lexsort((np.arange(len(right)), d))[:5]
        assert g.sort_values("rank")["ref"].tolist() == want.tolist()


def test_thinning_meets_the_retention_exactly(spark):
    rng = np.random.default_rng(9)
    at = np.vstack([rng.random((700, 2)) * 30, rng.random((200, 2)) * 2000])  # most points in a few cells
    rows = [(i, float(x), float(y), -float(rng.integers(1, 30)), "multibeam" if i % 3 else "atl24", 1.0, float(rng.random())) for i, (x, y) in enumerate(at)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, depth_m double, source string, sample_weight double, complexity double")
    kept = sampling.adaptive_thinned(df).toPandas()
    for source, share in (("multibeam", 0.8), ("atl24", 0.3)):
        n = sum(r[4] == source for r in rows)
        assert (kept["source"] == source).sum() >= np.ceil(share * n)
    assert kept["point_id"].is_unique and (kept["source"] == "multibeam").sum() == np.ceil(0.8 * sum(r[4] == "multibeam" for r in rows))
    assert sampling.adaptive_thinned(df.limit(0)).count() == 0


def test_complexity_without_any_spread_is_one_as_in_the_twins(spark):
    flat = spark.createDataFrame([(i, float(i % 9), float(i // 9), -3.7) for i in range(81)], "point_id long, x double, y double, depth_m double")
    assert {r["complexity"] for r in sampling.relative_complexity(flat).collect()} == {1.0}
    some = flat.withColumn("depth_m", F.when(F.col("point_id") == 40, -9.0).otherwise(F.col("depth_m")))
    got = [r["complexity"] for r in sampling.relative_complexity(some).collect()]
    assert max(got) == 0.5 and min(got) == 0.1


def test_water_components_cover_every_water_cell(spark, sf_dir):
    from shoalspark.plans.fixtures import view
    from shoalspark.plans.queries import ORACLE_SQL, QUERIES

    assert QUERIES["n7_water_components"](spark, sf_dir).count() == view(spark, sf_dir, "fx_pixels").where("scl BETWEEN 4 AND 8").count()
    assert "land = 0" not in ORACLE_SQL["n7_water_components"].split("RECURSIVE")[-1]


def test_stations_meet_distinct_places_only(spark):
    from shoalspark.operators import surveys

    many = spark.range(20_000).select(F.col("id").alias("point_id"), (F.col("id") % 2 * 10.0).alias("x"), F.lit(0.0).alias("y"))
    stations = spark.range(300).select(F.col("id").alias("sid"), F.lit(4.0).alias("sx"), F.lit(0.0).alias("sy"))
    most = spark.sparkContext.accumulator(0)
    real = surveys.nearest_within

    def counted(left, *more):
        most.add(left.count())
        return real(left, *more)

    surveys.nearest_within = counted
    try:
        got = surveys.nearest_station(many, stations, "point_id", 5.0).collect()
    finally:
        surveys.nearest_within = real
    assert most.value == 2 and len(got) == 10_000 and {(r["sid"], r["dist"]) for r in got} == {(0, 4.0)}


def test_a_long_track_is_few_cells(spark):
    from shoalspark.operators import surveys

    photons = spark.createDataFrame([(1, float(i), 30.0 + i * 8.0, -88.0 + i * 8.0) for i in range(8)], "g int, t double, latitude double, longitude double")
    points = spark.createDataFrame([(1, 30.0, -88.0), (2, 30.0, -88.0), (3, 0.0, 0.0)], "point_id long, latitude double, longitude double")
    picks = photons.where("t = 0").withColumn("ws_h", F.lit(1.5)).drop("t")
    _, surface = surveys.linked_chunks(picks, photons, points, ["g"], "t", cell=1e-8)  # billions of cells of this size
    assert sorted((r["point_id"], r["dist_m"], r["surface_m"]) for r in surface.collect()) == [(1, 0.0, 1.5), (2, 0.0, 1.5)]

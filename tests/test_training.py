"""The training chain on planted points, and the choice of a final depth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalspark.operators import selection, training


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        blue = float(rng.uniform(0.02, 0.2))
        index = math.log(blue) / math.log(0.05)
        far = 6.0 if i % 45 == 0 else 0.0  # planted outliers
        depth = 2 + 8 * index + far + float(rng.normal(0, 0.05))
        rows.append((i, float(i % 30), float(i // 30), "extra_xyz" if i % 10 == 3 else "atl03" if i % 2 else None, None if i % 7 == 0 else 2.0, -depth, blue, 0.05, 0.03, 0.01))
    rows.append((900, 0.0, 0.0, "atl03", 1.0, -5.0, float("nan"), 0.05, 0.03, 0.01))
    rows.append((901, 0.0, 0.0, "atl03", 1.0, None, 0.1, 0.05, 0.03, 0.01))
    return spark.createDataFrame(rows, "point_id long, x double, y double, source string, sample_weight double, depth_m double, b02 double, b03 double, b04 double, b08 double")


@pytest.mark.parametrize("split", ["strata", "clusters"])
def test_chain_drops_outliers_and_keeps_test_rows_out(points, split):
    t = training.train_depth_model(points, 20.0, trees=8, depth=8, least=5, target_rmse=1.0, split=split, physics_m=9.0)
    rows = {r["point_id"]: r for r in t.rows.collect()}
    assert not [i for i in rows if i % 45 == 0 and i < 900] and 900 not in rows and 901 not in rows and len(rows) > 850
    test = [r for r in rows.values() if r["is_test"]]
    assert test and all(r["source"] != "extra_xyz" and not r["is_train"] for r in test)
    assert all(r["is_train"] for r in rows.values() if not r["is_test"])
    if split == "strata":
        others = sum(r["source"] != "extra_xyz" for r in rows.values())
        assert abs(len(test) - 0.2 * others) <= 20
    fit = [(r["stumpf_idx"], r["depth_pos"]) for r in rows.values() if r["is_train"]]
    assert np.allclose(t.line, np.polyfit(*zip(*fit, strict=True), 1), atol=1e-9) and t.features[-1] == "stumpf_depth"
    lo, hi = np.percentile([r["b02"] for r in rows.values()], [0.5, 99.5])
    assert np.allclose(t.bounds["b02"], (lo - 0.1 * (hi - lo), hi + 0.1 * (hi - lo)))
    f = t.funnel.first()
    assert (f["points"], f["complete"], f["test"]) == (902, len(rows), len(test)) and f["train"] + f["test"] <= f["complete"]
    limits = t.limits.first()
    assert limits["physics_m"] == 9.0 and limits["final_m"] == min(9.0, limits["strict_m"] or 9.0) and limits["source"] == "combined"
    by = {(r["layer"], r["source"]): r for r in training.accuracy_by_layer(t).collect()}
    assert by[("train", "extra_xyz")]["n"] == sum(r["source"] == "extra_xyz" and r["is_train"] for r in rows.values())
    assert all(r["rmse"] < 3 for r in by.values())


def test_survey_rows_alone_are_split_and_deep_rows_stay_out_of_training(points):
    t = training.train_depth_model(points.where("source = 'extra_xyz'"), 12.0, trees=3, depth=4, least=5)
    rows = t.rows.collect()
    assert any(r["depth_pos"] > 12 for r in rows)  # beyond the gate's depths
    assert all(r["is_train"] == (r["depth_pos"] <= 12) for r in rows if not r["is_test"])
    assert t.funnel.first()["test"] > 0 and t.funnel.first()["train"] > 0


def test_final_depth_falls_back_in_order(spark):
    one = spark.createDataFrame([(9.0, 7.0, 15.0, 20.0), (None, 7.0, 15.0, 20.0), (9.0, None, 15.0, 20.0), (None, None, 15.0, 20.0), (None, None, None, 11.0), (None, None, None, None)], "p double, r double, q double, g double")
    pick = lambda kind: [tuple(r["f"]) for r in one.select(training.final_depth(kind, *(F.col(c) for c in "prqg")).alias("f")).collect()]
    tail = [(15.0, "training_p95"), (11.0, "given"), (20.0, "default")]
    assert pick("combined") == [(7.0, "combined"), (7.0, "combined"), (9.0, "combined"), *tail]
    assert pick("physics") == [(9.0, "physics"), (7.0, "combined"), (9.0, "physics"), *tail]
    assert pick("rmse") == [(7.0, "rmse"), (7.0, "rmse"), tail[0], *tail] and pick("training_p95") == [tail[0]] * 4 + tail[1:]
    with pytest.raises(ValueError):
        pick("other")


def test_adaptive_split_thins_to_the_share(spark):
    df = spark.createDataFrame([(i, i % 6, float(i % 6 * 3 + i % 5)) for i in range(600)], "point_id long, cluster int, depth_m double")
    got = selection.adaptive_split(df).collect()
    chosen = {r["cluster"] for r in selection.spanning_test_clusters(df).where("chosen").collect()}
    test = [r for r in got if r["is_test"]]
    assert len(got) == 600 and len(test) == 120 and {r["cluster"] for r in test} <= chosen
    want = sorted((r["point_id"] for r in got if r["cluster"] in chosen), key=lambda i: ((i * 7919 + 42) % 10007, i))[:120]
    assert sorted(r["point_id"] for r in test) == sorted(want)


def test_report_of_a_search(spark, points):
    t = points.where("depth_m is not null and not isnan(b02)").withColumns({"fold": (F.col("y") / 10).cast("int"), "depth_pos": F.abs("depth_m")})
    scores = selection.search_scores(t, ["b02"], "depth_pos", draws=2, ranges={"numTrees": (2, 4), "maxDepth": (2, 5)})
    scores = scores.unionByName(scores.where("draw = 1").withColumn("draw", F.lit(7))).unionByName(scores.limit(1).withColumn("draw", F.lit(9)).withColumn("rmse", F.lit(None).cast("double")))
    got, rows = selection.tuning_report(scores).collect(), scores.collect()
    mean = {d: np.mean([r["rmse"] for r in rows if r["draw"] == d]) for d in (0, 1, 7)}
    assert [r["draw"] for r in got] == sorted(mean, key=lambda d: (round(mean[d], 9), d)) and [r["rank"] for r in got] in ([1, 2, 2], [1, 1, 3])
    assert all(abs(r["mean_rmse"] - mean[r["draw"]]) < 1e-8 and "numTrees" in r["params"] and r["folds"] == 3 for r in got)

"""As-of joins, modes of a density and whole scene prediction against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalspark.operators import modelling, ordered, pipelines, surveys
from shoalspark.plans.fixtures import view


@pytest.mark.parametrize("run", [4, 4096])
def test_as_of_joins_over_runs(spark, monkeypatch, run):
    monkeypatch.setattr(ordered, "RUN", run)
    rng = np.random.default_rng(run)
    right = [("a", float(t), float(rng.integers(0, 9))) for t in rng.integers(0, 60, 40)] + [("b", 5.0, 2.0), ("b", None, 9.0), ("b", 7.0, None), (None, 1.0, 4.0)]
    left = [(i, g, None if rng.random() < 0.1 else float(rng.integers(-10, 80)) / 2) for i, g in enumerate(["a"] * 60 + ["b"] * 9 + ["c"] * 3 + [None] * 3)]
    a = spark.createDataFrame(left, "id int, g string, t double")
    b = spark.createDataFrame(right, "g string, t double, v double")
    got = {r["id"]: r["interpolated"] for r in surveys.interpolated_as_of(a, b, ["g"], "t", "v").collect()}
    near = {r["id"]: (r["nearest_at"], r["nearest_value"]) for r in surveys.nearest_prediction(a, b, ["g"], "t", "v", most=4.0).collect()}
    assert len(got) == len(near) == len(left)
    for i, g, t in left:
        known = {}
        for h, s, v in right:
            if h == g and s is not None and v is not None:
                known.setdefault(s, []).append(v)
        at = sorted(known)
        if t is None or not at:
            assert got[i] is None and near[i] == (None, None)
            continue
        assert math.isclose(got[i], np.interp(t, at, [np.mean(known[s]) for s in at]), abs_tol=1e-9)
        best = min(at, key=lambda s: (abs(s - t), s))
        assert near[i] == ((best, np.mean(known[best])) if abs(best - t) <= 4 else (None, None))


def modes_of(d, prominence=0.1, spacing=10):
    peaks = [i for i in range(1, len(d) - 1) if d[i] > d[i - 1] and d[i] > d[i + 1]]
    kept = []
    for p in sorted(peaks, key=lambda i: (-d[i], -i)):
        if all(abs(p - q) >= spacing for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        left = max((j for j in range(p) if d[j] > d[p]), default=0)
        right = min((j for j in range(p + 1, len(d)) if d[j] > d[p]), default=len(d) - 1)
        if d[p] - max(min(d[left : p + 1]), min(d[p : right + 1])) >= prominence * max(d):
            out.append(p)
    return out


@pytest.mark.parametrize("centres", [(0.0,), (-4.0, 4.0), (-6.0, 0.0, 7.0), (-1.0, 1.0)])
def test_modes_equal_brute_force(spark, centres):
    rng = np.random.default_rng(len(centres))
    values = np.concatenate([rng.normal(c, 0.8, 300 + 90 * i) for i, c in enumerate(centres)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "r double")
    curve = [(r["place"], r["density"]) for r in surveys.density_curve(df.where("r is not null and not isnan(r)"), "r").orderBy("i").collect()]
    want = modes_of([d for _, d in curve])
    got = surveys.bimodality(df, "r").first()
    assert (got["n"], got["n_modes"], got["is_bimodal"]) == (len(values), len(want), len(want) > 1)
    assert [m["place"] for m in got["modes"]] == pytest.approx([curve[i][0] for i in want])
    few = surveys.bimodality(df.limit(20), "r").first()
    assert (few["n_modes"], few["is_bimodal"]) == (0, False)


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    bands = ["b02", "b03", "b04"]
    px = view(spark, sf_dir, "fx_pixels").withColumn("depth", F.col("b03") * 50 + F.col("b02") * 20)
    assembler, model = modelling.fit_depth_model(px, bands, "depth", trees=12, depth=6)
    return bands, px, assembler, model


def test_spread_over_all_trees_by_either_way(spark, trained, monkeypatch):
    bands, px, assembler, model = trained
    rows = px.select("cell", *bands).unionByName(spark.createDataFrame([(-1, None, 0.1, 0.1), (-2, float("nan"), 0.1, 0.1)], "cell long, b02 double, b03 double, b04 double"))
    want = {r["cell"]: [t.predict(r["features"]) for t in model.trees] for r in assembler.transform(px.where("cell < 300")).collect()}
    flat = {r["cell"]: r for r in modelling.tree_spread(model, rows, bands).collect()}
    monkeypatch.setattr(modelling, "MOST_NODES", 10)
    one_by_one = {r["cell"]: r for r in modelling.tree_spread(model, rows, bands).collect()}
    assert want
    for found in (flat, one_by_one):
        assert found[-1]["tree_mean_m"] is None and found[-2]["tree_std_m"] is None and len(found) == px.count() + 2
        for cell, each in want.items():
            assert math.isclose(found[cell]["tree_mean_m"], np.mean(each), abs_tol=1e-9) and math.isclose(found[cell]["tree_std_m"], np.std(each), abs_tol=1e-6)


def test_scene_prediction_keeps_every_cell_and_counts_its_steps(spark, trained):
    bands, px, assembler, model = trained
    bounds = {b: (0.0, 0.06) for b in bands}
    kd = F.lit(0.4)
    scene, funnel = pipelines.scene_prediction(px, model, bands, bounds, 5.0, kd, F.col("scl") == 6, physical=F.col("b03") * 90)
    rows = {r["cell"]: r for r in scene.collect()}
    assert len(rows) == px.count()
    steps = {r["step"]: r["n"] for r in funnel.collect()}
    valid = {r["cell"]: r for r in assembler.transform(px.where("scl = 6")).collect()}
    assert steps["all"] == len(rows) and steps["valid"] == steps["known"] == len(valid)
    limit, shown = 2.3 / 0.4, 0
    for cell, r in rows.items():
        if cell not in valid:
            assert r["depth_m"] is None and r["sigma_m"] is None
            continue
        each = [t.predict(valid[cell]["features"]) for t in model.trees]
        mean, std = np.mean(each), np.std(each)
        z, p = mean, valid[cell]["b03"] * 90
        if p > mean:
            edge = min(1, max(0, (mean - 3.5) / 1.6))
            w = max(0.3 * min(1, std / 0.25), edge * min(1, max(0, p - mean)))
            z = (1 - w) * mean + w * p
        if 0 < z <= limit:
            assert math.isclose(r["depth_m"], -z, abs_tol=1e-6) and r["sigma_m"] > 0
            shown += 1
        else:
            assert r["depth_m"] is None
    assert shown == steps["within_limit"] > 0

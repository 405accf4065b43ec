"""Steps whose shuffles grew with rows times neighbours, or whose tasks held a group: one place is searched once, a row's neighbours stay a list."""

import numpy as np
from pyspark.sql import functions as F

from shoalspark.operators import points, sampling, selection, surveys


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _points(spark, n=400, places=40):
    at = spark.range(n).select(F.col("id").alias("point_id"), (F.col("id") * 37 % places).alias("p"), F.when(F.col("id") % 13 > 0, -(F.col("id") * 11 % 71) / 10).alias("depth_m"))
    return at.select("point_id", (F.col("p") % 7 * 3.0).alias("x"), (F.col("p") * 2.0).alias("y"), "depth_m")


def test_complexity_searches_each_place_once(spark, monkeypatch):
    seen = []
    search = sampling.neighbour_lists
    monkeypatch.setattr(sampling, "neighbour_lists", lambda left, *a: seen.append(left.count()) or search(left, *a))
    p = _points(spark)
    got = {r["point_id"]: r["complexity"] for r in sampling.relative_complexity(p, sampling.Sampling(k=12)).collect()}
    assert seen == [40]
    t = p.toPandas()
    d = np.sqrt((t["x"].to_numpy()[:, None] - t["x"].to_numpy()) ** 2 + (t["y"].to_numpy()[:, None] - t["y"].to_numpy()) ** 2)
    spread = np.array([np.nanstd(t["depth_m"].to_numpy()[np.lexsort((t["point_id"], row))[:12]]) for row in d])
    assert np.allclose([got[i] for i in t["point_id"]], np.clip(0.4 * spread / spread.max() + 0.1, 0, 1), atol=2e-9)


def test_transects_keep_neighbours_in_a_list(spark):
    p = _points(spark, 300, 150)
    out = points.transects(p, k=12)
    assert "Window" not in plan(out)
    got = {r["point_id"]: r for r in out.collect()}
    t = p.toPandas()
    x, y = t["x"].to_numpy(), t["y"].to_numpy()
    for i in range(0, len(t), 7):
        d = np.sqrt((x - x[i]) ** 2 + (y - y[i]) ** 2)
        near = [j for j in np.lexsort((t["point_id"], d))[:12] if j != i][:11]
        u, v = x[near] - x[i], y[near] - y[i]
        angle = 0.5 * np.arctan2(2 * (u * v).sum(), (u * u - v * v).sum())
        along = (np.abs(u * np.cos(angle) + v * np.sin(angle)) > 0.9 * d[near]) & (d[near] > 0)
        assert np.isclose(got[t["point_id"][i]]["aligned_share"], along.mean())


def test_no_task_reads_a_group_of_residuals(spark):
    df = spark.range(2000).select("id", (F.col("id") % 2).alias("land"), (F.col("id") % 97 / 10).alias("i")).withColumn("z", 3 * F.col("i") + F.when(F.col("id") % 50 == 0, 9.0).otherwise(0.0))
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = selection.line_residual_filter(df, "id", "i", "z", ("land",))
        assert "SortMergeJoin [land" not in plan(out) and out.count() == 1960
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_surface_spreads_few_points_of_a_place_and_drops_far_queries(spark, monkeypatch):
    sent = []
    few = surveys.few_at_a_place
    monkeypatch.setattr(surveys, "few_at_a_place", lambda *a: sent.append(few(*a)) or sent[-1])
    p = spark.range(4000).selectExpr("id AS point_id", "id % 20 * 1e1 AS x", "id % 20 * 7 % 11 * 9e0 AS y", "id % 31 * 1e-1 AS depth_m")
    near = spark.range(100).selectExpr("id AS cell", "id % 10 * 2e1 AS x", "id div 10 * 1e1 AS y")
    far = spark.range(300).selectExpr("1000 + id AS cell", "9e5 + id AS x", "0e0 AS y")
    alone, both = (surveys.local_kernel_surface(q, p, "depth_m", 50.0, k=8).toPandas().set_index("cell").sort_index() for q in (near, near.unionByName(far)))
    assert sent[0].count() == 20 * 8
    assert both["depth"].iloc[100:].isna().all() and np.allclose(both["depth"].iloc[:100], alone["depth"]) and alone["depth"].notna().all()

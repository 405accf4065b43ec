"""Queries of spatial folds, cross-validation, searches, stacks, residual filters and bottom spectra."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.operators import joins, modelling, selection, training
from shoalspark.plans.registry import query
from shoalspark.plans.table_queries import _ACC, _PRED, _predicted

C = F.col
BANDS = ["b02", "b03", "b04", "b08"]
_BLOCK = "CAST(((floor(x / 300)::BIGINT * 31 + floor(y / 300)::BIGINT * 17) % 9 + 9) % 9 AS INT)"
_STATS = f"""p AS (SELECT *, {_BLOCK} AS cluster FROM fx_points), s AS (SELECT cluster, count(depth_m) AS n, avg(depth_m) AS mean, stddev_pop(depth_m) AS std, min(depth_m) AS least, max(depth_m) AS most, quantile_cont(depth_m, 0.25) AS p25, median(depth_m) AS p50,
    quantile_cont(depth_m, 0.75) AS p75, quantile_cont(depth_m, 0.95) AS p95 FROM p GROUP BY cluster)"""


def _blocks(p):
    return modelling.block_folds(p, 300.0, 9).withColumnRenamed("fold", "cluster")


def _training(p, px):
    t = joins.sampled_at(p, px, BANDS, 5e5, 3.4e6, 10.0).withColumn("depth_pos", F.abs("depth_m")).dropna(subset=BANDS)
    return t.select("point_id", "x", "y", *BANDS, "depth_m", "depth_pos")


@query("a35_m4_cluster_scores", "fx_points", doubles="mean std least most p25 p50 p75 p95 score", twin=f"WITH {_STATS} SELECT s.*, abs(p50 - (SELECT median(depth_m) FROM p)) + abs(p95 - (SELECT quantile_cont(depth_m, 0.95) FROM p)) AS score FROM s WHERE n >= 50")
def _(p):
    return selection.representative_scores(_blocks(p))


@query("m2_tail_split", "fx_points", twin=f"""WITH {_STATS} SELECT point_id, cluster = (SELECT cluster FROM s WHERE n >= 50 ORDER BY abs(p95 - (SELECT quantile_cont(depth_m, 0.95) FROM p)), cluster LIMIT 1) AS is_test FROM p""")
def _(p):
    return selection.tail_split(_blocks(p)).select("point_id", "is_test")


_NEAR_Q = " UNION ALL ".join(f"SELECT * FROM (SELECT cluster FROM s ORDER BY abs(p50 - (SELECT min(least) FROM s) - {q} * (SELECT max(most) - min(least) FROM s)), cluster LIMIT 1)" for q in (0.25, 0.5, 0.75))


@query("m7_spanning_test_clusters", "fx_points", twin=f"""WITH {_STATS}, m AS (SELECT * FROM (SELECT cluster FROM s ORDER BY least, cluster LIMIT 1) UNION ALL SELECT * FROM (SELECT cluster FROM s ORDER BY most DESC, cluster LIMIT 1) UNION ALL {_NEAR_Q}), i AS (SELECT cluster, n, cluster IN (SELECT cluster FROM m) AS must FROM s)
    SELECT cluster, n, must OR coalesce(sum(n) OVER (ORDER BY must DESC, n DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.5 * (SELECT sum(n) FROM s) AS chosen FROM i""")
def _(p):
    return selection.spanning_test_clusters(_blocks(p), share=0.5)


@query("m7_adaptive_split", "fx_points", twin=f"""WITH {_STATS}, m AS (SELECT * FROM (SELECT cluster FROM s ORDER BY least, cluster LIMIT 1) UNION ALL SELECT * FROM (SELECT cluster FROM s ORDER BY most DESC, cluster LIMIT 1) UNION ALL {_NEAR_Q}), i AS (SELECT cluster, n, cluster IN (SELECT cluster FROM m) AS must FROM s),
    c AS (SELECT cluster, must OR coalesce(sum(n) OVER (ORDER BY must DESC, n DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.2 * (SELECT sum(n) FROM s) AS chosen FROM i),
    t AS (SELECT point_id, row_number() OVER (ORDER BY (point_id * 7919 + 42) % 10007, point_id) AS r, count(*) OVER () AS k FROM p JOIN c USING (cluster) WHERE chosen), z AS (SELECT count(*) AS n FROM p)
    SELECT p.point_id, t.r IS NOT NULL AND (t.k <= 0.25 * z.n OR t.r <= floor(0.2 * z.n)) AS is_test FROM p CROSS JOIN z LEFT JOIN t ON t.point_id = p.point_id""")
def _(p):
    return selection.adaptive_split(_blocks(p)).select("point_id", "is_test")


@query("m7_adaptive_folds", "fx_points")
def _(p):
    k = selection.adaptive_cluster_count(p)
    return selection.cluster_statistics(selection.clustered(p, k, hierarchical=True))


@query("m8_fold_summary", "fx_points", doubles="rmse_mean rmse_std mae_mean mae_std r2_mean r2_std", twin=f"""SELECT count(*) AS folds, avg(rmse) AS rmse_mean, stddev_pop(rmse) AS rmse_std, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std, avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std FROM (SELECT {_BLOCK} AS fold, {_ACC} FROM {_PRED} GROUP BY 1)""")
def _(p):
    scored = modelling.block_folds(_predicted(p), 300.0, 9).withColumnRenamed("pred", "predicted_m")
    return selection.summary(selection.fold_metrics(scored, "depth_m"))


@query("m8_compared_strategies", "fx_points fx_pixels")
def _(p, px):
    return selection.compared_strategies(BANDS, "depth_pos", selection.block_strategies(_training(p, px), 3), trees=8, depth=6)


@query("m6_m8_buffered_folds", "fx_points fx_pixels")
def _(p, px):
    t = modelling.block_folds(_training(p, px), 300.0, 3)
    forest = RandomForestRegressor(featuresCol="features", labelCol="depth_pos", predictionCol="predicted_m", numTrees=8, maxDepth=6, seed=42)
    return selection.fold_metrics(selection.out_of_fold(t, BANDS, "depth_pos", forest, [0, 1, 2], buffer_m=10.0), "depth_pos")


@query("m17_random_search", "fx_points fx_pixels")
def _(p, px):
    t = modelling.block_folds(_training(p, px), 300.0, 2)
    forest = selection.random_search(t, BANDS, "depth_pos", draws=2, ranges={"numTrees": (5, 10), "maxDepth": (4, 6)})
    boosted = selection.random_search(t, BANDS, "depth_pos", "boosting", 2, {"maxIter": (3, 5), "maxDepth": (3, 4)})
    return forest.select(F.lit("forest").alias("kind"), "draw", "rmse", "r2", "n").unionByName(boosted.select(F.lit("boosting").alias("kind"), "draw", "rmse", "r2", "n"))


@query("m18_stack", "fx_points fx_pixels")
def _(p, px):
    t = modelling.block_folds(_training(p, px), 300.0, 2)
    common = {"featuresCol": "features", "labelCol": "depth_pos", "predictionCol": "predicted_m", "seed": 42}
    scored, _ = selection.stacked(t, BANDS, "depth_pos", "point_id", {"forest": RandomForestRegressor(numTrees=8, maxDepth=6, **common), "boosting": GBTRegressor(maxIter=4, maxDepth=3, **common)})
    return selection.compared_models(scored, "depth_pos", ["forest", "boosting", "predicted_m"])


@query("m18_compared_models", "fx_points", doubles="rmse mae bias r2", twin=f"SELECT 'pred' AS model, {_ACC} FROM {_PRED} UNION ALL SELECT 'flat' AS model, {_ACC} FROM (SELECT depth_m, -5.0 AS pred FROM fx_points)")
def _(p):
    return selection.compared_models(_predicted(p).withColumn("flat", F.lit(-5.0)), "depth_m", ["pred", "flat"])


@query("m19_importance", "fx_points fx_pixels")
def _(p, px):
    _, model = modelling.fit_depth_model(_training(p, px), BANDS, "depth_pos")
    return selection.importance_table(p.sparkSession, model, BANDS)


#: (case, shift of the second variant's depths, coherence of the first, of the second)
_VARIANTS = (("near", 0.01, 0.4, 0.6), ("near_coherent", 0.01, 0.7, 0.6), ("equal", 0.0, 0.5, 0.5), ("deeper", -3.0, 0.4, 0.6), ("higher", 3.0, 0.6, 0.4))


@query(
    "m20_chosen_variant", "fx_points",
    twin=f"""WITH e AS (SELECT v.*, sqrt(avg(pow(pred - depth_m, 2))) AS a, sqrt(avg(pow(pred + shift - depth_m, 2))) AS b FROM {_PRED}, (VALUES {", ".join(map(str, _VARIANTS))}) v(variant, shift, c1, c2) GROUP BY ALL)
        SELECT variant, CASE WHEN a + 0.05 < b THEN 'one' WHEN b + 0.05 < a THEN 'two' WHEN c1 >= c2 THEN 'one' ELSE 'two' END AS name, CASE WHEN abs(a - b) > 0.05 THEN 'lower error' ELSE 'errors tie, higher coherence' END AS reason FROM e""",
)
def _(p):
    rmse = lambda n, shift, c: _predicted(p).agg(F.lit(n).alias("name"), F.sqrt(F.avg(F.pow(C("pred") + shift - C("depth_m"), F.lit(2.0)))).alias("rmse"), F.lit(c).alias("coherence"))
    chosen = [selection.chosen_variant(rmse("one", 0.0, c1), rmse("two", shift, c2)).select(F.lit(case).alias("variant"), "*") for case, shift, c1, c2 in _VARIANTS]
    return reduce(DataFrame.unionByName, chosen)


@query("m11_line_residuals", "fx_pixels")
def _(px):
    t = px.withColumn("i", F.ln("b02")).withColumn("z", 8 + 2 * C("i") + (C("cell") % 7 - 3) * 0.05 + F.when(C("cell") % 11 == 0, 4.0).otherwise(0.0)).withColumn("deep", C("land"))
    return selection.line_residual_filter(t, "cell", "i", "z", ("deep",)).select("cell")


@query("a55_bottom_endmembers", "fx_pixels")
def _(px):
    return selection.bottom_endmembers(px, ["b02", "b03", "b04"])


@query("a56_scene_endmembers", "fx_points fx_pixels")
def _(p, px):
    bands = ["b02", "b03", "b04"]
    each = lambda *v: dict(zip(bands, v, strict=True))
    return selection.scene_endmembers(_training(p, px), bands, each(0.08, 0.1, 0.3), each(0.09, 0.11, 0.33), each(0.015, 0.012, 0.008))


@query("m9_training_chain", "fx_points fx_pixels")
def _(p, px):
    points = joins.sampled_at(p, px, BANDS, 5e5, 3.4e6, 10.0)
    return training.accuracy_by_layer(training.train_depth_model(points, 20.0, trees=40, depth=12))


@query(
    "l8_tuning_report", "fx_points", doubles="mean_rmse std_rmse",
    twin="""WITH f AS (SELECT point_id % 23 AS draw, user_fold AS fold, sqrt(avg(pow(depth_m + 5 + point_id % 23 % 7, 2))) AS rmse FROM (SELECT *, CAST(floor(x / 300) AS INT) % 4 AS user_fold FROM fx_points) GROUP BY 1, 2),
        d AS (SELECT draw, concat('{"shift": ', draw % 7, '}') AS params, round(avg(rmse), 9) AS mean_rmse, stddev_pop(rmse) AS std_rmse, count(rmse) AS folds FROM f GROUP BY draw)
        SELECT * FROM (SELECT *, rank() OVER (ORDER BY mean_rmse) AS rank FROM d) ORDER BY rank, draw LIMIT 10""",
)
def _(p):
    drawn = p.select((C("point_id") % 23).alias("draw"), (F.floor(C("x") / 300) % 4).alias("fold"), "depth_m")
    e = C("depth_m") + 5 + C("draw") % 7
    scores = drawn.groupBy("draw", "fold").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return selection.tuning_report(scores.withColumn("params", F.concat(F.lit('{"shift": '), (C("draw") % 7).cast("string"), F.lit("}"))))

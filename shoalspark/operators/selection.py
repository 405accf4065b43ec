"""Spatial folds by clusters, cross-validation, searches and stacks of models, robust residual filters, bottom spectra."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalspark.functions.optics import bottom_reflectance, clip, path_attenuation
from shoalspark.operators.modelling import accuracy, block_folds, buffered_train
from shoalspark.operators.points import source_capped
from shoalspark.operators.quantiles import exact_quantiles, with_quantiles
from shoalspark.session import checkpointed, shuffled


def clustered(df: DataFrame, k: int, columns: tuple[str, ...] = ("x", "y"), seed: int = 42, hierarchical: bool = False) -> DataFrame:
    """``df`` with ``cluster`` by k-means, or by bisection; rows with a null in the columns are left out."""
    kind = BisectingKMeans if hierarchical else KMeans
    at = VectorAssembler(inputCols=list(columns), outputCol="_at", handleInvalid="skip").transform(df)
    return kind(featuresCol="_at", predictionCol="cluster", k=k, seed=seed).fit(at).transform(at).drop("_at")


def cluster_statistics(df: DataFrame, value: str = "depth_m") -> DataFrame:
    """Size, spread and quartiles of each cluster."""
    q = exact_quantiles(df, {"v": F.col(value)}, {"p25": ("v", 0.25), "p50": ("v", 0.5), "p75": ("v", 0.75), "p95": ("v", 0.95)}, ("cluster",))
    one = df.groupBy("cluster").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    return with_quantiles(one, q, ("cluster",))


def representative_scores(df: DataFrame, value: str = "depth_m", least: int = 50, tail_only: bool = False) -> DataFrame:
    """Statistics of the clusters with ``least`` rows, with their distance to the whole table's median and tail; lower is better."""
    whole = exact_quantiles(df, {"v": F.col(value)}, {"_p50": ("v", 0.5), "_p95": ("v", 0.95)})  # one row
    s = cluster_statistics(df, value).where(F.col("n") >= least).crossJoin(F.broadcast(whole))
    middle = F.lit(0.0) if tail_only else F.abs(F.col("p50") - F.col("_p50"))
    return s.withColumn("score", middle + F.abs(F.col("p95") - F.col("_p95"))).drop("_p50", "_p95")


def tail_split(df: DataFrame, value: str = "depth_m") -> DataFrame:
    """``is_test`` marks the cluster whose tail comes closest to the whole's; the lesser cluster of equals."""
    best = representative_scores(df, value, tail_only=True).agg(F.min_by("cluster", F.struct("score", "cluster")).alias("_best"))
    return df.crossJoin(F.broadcast(best)).withColumn("is_test", F.coalesce(F.col("cluster") == F.col("_best"), F.lit(False))).drop("_best")


def adaptive_cluster_count(df: DataFrame, value: str = "depth_m", least: int = 100, share: float = 0.2, folds: int = 5, low: int = 5, high: int = 50) -> int:
    """Clusters by the number of rows, half as many again where values vary much; one row reaches the driver."""
    n, mean, std = df.agg(F.count(value), F.avg(value), F.stddev_pop(value)).first()
    k = min(high, max(low, int(n / max(least, n * share / folds))))
    return min(high, int(k * 1.5)) if mean and std / abs(mean) > 0.5 else k


def spanning_test_clusters(df: DataFrame, value: str = "depth_m", share: float = 0.2) -> DataFrame:
    """Clusters for testing: those with the least and the most value, those nearest to the range's quartiles, then the largest until ``share`` of the rows is reached."""
    s = cluster_statistics(df, value)
    ends = s.agg(F.min("least").alias("_lo"), F.max("most").alias("_hi"), F.sum("n").alias("_all"), F.min_by("cluster", F.struct("least", "cluster")).alias("_a"), F.max_by("cluster", F.struct("most", -F.col("cluster"))).alias("_b"))
    t = s.crossJoin(F.broadcast(ends))
    near = lambda q: F.min_by("cluster", F.struct(F.abs(F.col("p50") - F.col("_lo") - q * (F.col("_hi") - F.col("_lo"))), "cluster"))
    must = t.agg(F.array(F.first("_a"), F.first("_b"), *(near(q) for q in (0.25, 0.5, 0.75))).alias("_must"))
    t = t.crossJoin(F.broadcast(must)).withColumn("_in", F.array_contains("_must", F.col("cluster")))
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("_in").desc(), F.col("n").desc(), "cluster").rowsBetween(Window.unboundedPreceding, -1)  # one row a cluster
    before = F.coalesce(F.sum("n").over(w), F.lit(0))
    return t.withColumn("chosen", F.col("_in") | (before < share * F.col("_all"))).select("cluster", "n", "chosen")


def adaptive_split(labelled: DataFrame, value: str = "depth_m", share: float = 0.2, drift: float = 0.05, seed: int = 42) -> DataFrame:
    """``labelled`` (point_id, cluster) with ``is_test``: the rows of the clusters that span the values, thinned to ``share`` of all rows where they are more by ``drift``.

    Thinned rows, in an order made of the ids, train; ids are distinct. One row of counts reaches the driver.
    """
    chosen = spanning_test_clusters(labelled, value, share).where("chosen").select("cluster")
    test = checkpointed(labelled.join(F.broadcast(chosen), "cluster").select("point_id"))  # one row a cluster
    n, k = labelled.count(), test.count()
    most = int(share * n)
    if most > 0 and k > (share + drift) * n:
        test = source_capped(test.withColumn("source", F.lit(0)), most, seed).select("point_id")
    return labelled.join(test.withColumn("_test", F.lit(True)), "point_id", "left").withColumn("is_test", F.coalesce("_test", F.lit(False))).drop("_test")


def cluster_folds(df: DataFrame, folds: int, hierarchical: bool = False, seed: int = 42) -> DataFrame:
    return clustered(df, folds, seed=seed, hierarchical=hierarchical).withColumnRenamed("cluster", "fold")


# -- cross-validation


def _forest(target: str, trees: int, depth: int, leaf: int, seed: int, **more) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol="predicted_m", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed, **more)


def out_of_fold(df: DataFrame, features: list[str], target: str, regressor, folds: list[int], buffer_m: float | None = None, least: tuple[int, int] = (50, 20)) -> DataFrame | None:
    """Predictions for each fold by a model of the others; a fold with too few rows is passed over, None if all are.

    ``buffer_m`` keeps training rows away from the fold's (needs point_id, x, y).
    """
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=[*features, target])).cache()
    size = {r[0]: r[1] for r in ready.groupBy("fold").count().collect()}  # one row a fold
    out = None
    for f in folds:
        train = ready.where(F.col("fold") != f) if buffer_m is None else buffered_train(ready, f, buffer_m)
        n = sum(size.values()) - size.get(f, 0) if buffer_m is None else train.count()
        if n < least[0] or size.get(f, 0) < least[1]:
            continue
        scored = regressor.fit(train).transform(ready.where(F.col("fold") == f)).drop("features")
        out = scored if out is None else out.unionByName(scored)
    held = None if out is None else checkpointed(out)
    ready.unpersist()
    return held


def fold_metrics(scored: DataFrame, target: str) -> DataFrame:
    return scored.groupBy("fold").agg(*accuracy(F.col(target), F.col("predicted_m")))


def summary(metrics: DataFrame) -> DataFrame:
    """Mean and population spread of the folds' measures, one row."""
    return metrics.agg(F.count(F.lit(1)).alias("folds"), *(f(c).alias(f"{c}_{n}") for c in ("rmse", "mae", "r2") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))))


def compared_strategies(features: list[str], target: str, strategies: dict[str, DataFrame], trees: int = 150, depth: int = 15, leaf: int = 5, seed: int = 42) -> DataFrame:
    """Summary of one forest under several assignments of folds (name to the table with ``fold``)."""
    rows = []
    for name, folded in strategies.items():
        folded = checkpointed(folded)  # read by each fold, in as many parts as its files fill
        ids = sorted(r[0] for r in folded.select("fold").distinct().collect())  # the folds' numbers
        scored = out_of_fold(folded, features, target, _forest(target, trees, depth, leaf, seed), ids)
        if scored is not None:
            rows.append(summary(fold_metrics(scored, target)).select(F.lit(name).alias("strategy"), "*"))
    if not rows:
        raise ValueError("no fold of any strategy has enough rows")
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# Ranges that a random search draws from.
FOREST_RANGES = {"numTrees": (20, 60), "maxDepth": (6, 14), "minInstancesPerNode": (1, 8)}
BOOSTING_RANGES = {"maxIter": (10, 30), "maxDepth": (3, 6), "minInstancesPerNode": (1, 8)}


def _drawn(folded: DataFrame, features: list[str], target: str, kind: str, draws: int, ranges: dict[str, tuple[int, int]] | None, seed: int):
    """Each draw's number, parameters and out-of-fold predictions."""
    rng = np.random.default_rng(seed)
    folded = checkpointed(folded)  # read by each draw, in as many parts as its files fill
    ids = sorted(r[0] for r in folded.select("fold").distinct().collect())  # the folds' numbers
    ranges = ranges or (FOREST_RANGES if kind == "forest" else BOOSTING_RANGES)
    model = RandomForestRegressor if kind == "forest" else GBTRegressor
    for i in range(draws):
        drawn = {p: int(rng.integers(lo, hi + 1)) for p, (lo, hi) in ranges.items()}
        scored = out_of_fold(folded, features, target, model(featuresCol="features", labelCol=target, predictionCol="predicted_m", seed=seed, **drawn), ids)
        if scored is None:
            raise ValueError("no fold has enough rows")
        yield i, drawn, scored


def random_search(folded: DataFrame, features: list[str], target: str, kind: str = "forest", draws: int = 5, ranges: dict[str, tuple[int, int]] | None = None, seed: int = 42) -> DataFrame:
    """One row a draw: its parameters and its error over the folds, best first."""
    out = None
    for i, drawn, scored in _drawn(folded, features, target, kind, draws, ranges, seed):
        row = scored.agg(*accuracy(F.col(target), F.col("predicted_m"))).select(F.lit(i).alias("draw"), *(F.lit(v).alias(p) for p, v in drawn.items()), "rmse", "r2", "n")
        out = row if out is None else out.unionByName(row)
    return out.orderBy("rmse", "draw")


def search_scores(folded: DataFrame, features: list[str], target: str, kind: str = "forest", draws: int = 5, ranges: dict[str, tuple[int, int]] | None = None, seed: int = 42) -> DataFrame:
    """One row a draw and fold: ``draw``, ``params`` (JSON), ``fold``, ``rmse``; what a tuning report is made of."""
    out = None
    for i, drawn, scored in _drawn(folded, features, target, kind, draws, ranges, seed):
        rows = fold_metrics(scored, target).select(F.lit(i).alias("draw"), F.lit(json.dumps(drawn)).alias("params"), "fold", "rmse")
        out = rows if out is None else out.unionByName(rows)
    return out


def tuning_report(scores: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best draws: ``rank`` (equal means share one), mean and deviation of the error over the folds, parameters; of equals the lesser draws. Draws without an error take no part."""
    each = scores.groupBy("draw").agg(F.min("params").alias("params"), F.round(F.avg("rmse"), 9).alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"), F.count("rmse").alias("folds")).where(F.col("folds") > 0)
    ranked = each.withColumn("rank", F.rank().over(Window.partitionBy(F.lit(1)).orderBy("mean_rmse")))  # one row a draw
    return ranked.orderBy("rank", "draw").limit(n)


def stacked(folded: DataFrame, features: list[str], target: str, key: str, regressors: dict[str, object]) -> tuple[DataFrame, object]:
    """Out-of-fold predictions of each regressor as columns with their linear blend, and the blend's model."""
    ids = sorted(r[0] for r in folded.select("fold").distinct().collect())  # the folds' numbers
    table = folded.select(key, "fold", target)
    for name, r in regressors.items():
        table = table.join(shuffled(out_of_fold(folded, features, target, r, ids).select(key, F.col("predicted_m").alias(name))), key)
    table = VectorAssembler(inputCols=list(regressors), outputCol="features").transform(table)
    blend = LinearRegression(featuresCol="features", labelCol=target, predictionCol="predicted_m").fit(table)
    return blend.transform(table).drop("features"), blend


def compared_models(scored: DataFrame, target: str, predictions: list[str]) -> DataFrame:
    """Accuracy of several prediction columns, one row each, in one pass."""
    long = scored.select(target, F.explode(F.array(*(F.struct(F.lit(p).alias("model"), F.col(p).alias("p")) for p in predictions))).alias("e")).select(target, "e.*")
    return long.groupBy("model").agg(*accuracy(F.col(target), F.col("p")))


def importance_table(spark, model, features: list[str]) -> DataFrame:
    """Features by importance; one row a feature."""
    rows = sorted(zip(features, (float(v) for v in model.featureImportances.toArray()), strict=True), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)], "feature string, importance double, rank int")


def chosen_variant(first: DataFrame, second: DataFrame, margin: float = 0.05) -> DataFrame:
    """One of two one-row tables (name, rmse, coherence): the lower error if by more than the margin, else the higher coherence, the first of equals."""
    a, b = (F.struct("name", "rmse", "coherence").alias(n) for n in "ab")
    pair = first.select(a).crossJoin(second.select(b))  # one row each
    by_error = F.when(F.col("a.rmse") + margin < F.col("b.rmse"), "a").when(F.col("b.rmse") + margin < F.col("a.rmse"), "b")
    tie = F.when(F.coalesce("a.coherence", F.lit(0.0)) >= F.coalesce("b.coherence", F.lit(0.0)), "a").otherwise("b")
    why = F.when(by_error.isNotNull(), "lower error").when(F.col("a.rmse").isNull() | F.col("b.rmse").isNull(), "no error known, higher coherence").otherwise("errors tie, higher coherence")
    side = F.coalesce(by_error, tie)
    return pair.select(F.when(side == "a", F.col("a.name")).otherwise(F.col("b.name")).alias("name"), why.alias("reason"))


# -- residuals and spectra


def line_residual_filter(df: DataFrame, key: str, index: str, depth: str, groups: tuple[str, ...] = (), trials: int = 20, share: float = 0.6, limit_m: float = 0.5, k: float = 2.5, least: tuple[int, int] = (200, 100)) -> DataFrame:
    """Drop rows far from a robust line of depth on index, group by group.

    Each trial fits a hash-chosen share of the rows; the one with the most rows
    within ``limit_m`` wins and is fitted again on them. Groups with too few
    rows or inliers stay whole, and so do rows without index or depth.
    """
    known = df.where(F.col(index).isNotNull() & F.col(depth).isNotNull()).select(key, *groups, index, depth)
    drawn = known.withColumn("_trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).where(F.pmod(F.xxhash64(key, "_trial"), F.lit(1000)) < int(share * 1000))
    line = lambda d, *g: d.groupBy(*groups, *g).agg(F.regr_slope(depth, index).alias("_a"), F.regr_intercept(depth, index).alias("_b"), F.count(F.lit(1)).alias("_k"))
    lines = line(drawn, "_trial").groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("_trial", "_a", "_b"))).alias("_lines"))  # ``trials`` a group
    meet = lambda left, right: left.join(F.broadcast(right), list(groups)) if groups else left.crossJoin(F.broadcast(right))  # one row a group, so that no task reads a group whole
    off = lambda a, b: F.abs(F.col(depth) - (F.col(a) * F.col(index) + F.col(b)))
    tried = meet(known, lines).withColumn("_l", F.explode("_lines")).select(*groups, index, depth, "_l.*")
    best = tried.groupBy(*groups, "_trial").agg(F.first("_a").alias("_a"), F.first("_b").alias("_b"), F.count_if(off("_a", "_b") <= limit_m).alias("_hits"))
    best = best.groupBy(*groups).agg(F.max_by(F.struct(F.col("_a").alias("_a0"), F.col("_b").alias("_b0")), F.struct("_hits", -F.col("_trial"))).alias("_best")).select(*groups, "_best.*")
    best = checkpointed(best)  # read by each of the steps below
    inner = meet(known, best).where(off("_a0", "_b0") <= limit_m)
    final = checkpointed(line(inner))
    spread = meet(inner, final).groupBy(*groups).agg(F.stddev_pop(off("_a", "_b")).alias("_s"))
    size = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    rule = meet(meet(final, spread), size).where((F.col("_n") >= least[0]) & (F.col("_k") >= least[1]))
    bad = meet(known, rule).where(off("_a", "_b") > F.greatest(F.lit(limit_m), k * F.coalesce("_s", F.lit(0.0)))).select(key)
    return df.join(bad, key, "left_anti")


def bottom_endmembers(samples: DataFrame, bands: list[str], sand: float = 0.95, grass: float = 0.05, least: int = 10) -> DataFrame | None:
    """Bright and dark bottom spectrum on the samples' main axis, one row a band; None with fewer than ``least`` samples.

    Only the means and the bands' covariances reach the driver.
    """
    known = samples.dropna(subset=bands)
    pairs = [(i, j) for i in range(len(bands)) for j in range(i, len(bands))]
    row = known.agg(F.count(F.lit(1)), *(F.avg(b) for b in bands), *(F.covar_samp(bands[i], bands[j]) for i, j in pairs)).first()
    if row[0] < least:
        return None
    mean, cov = np.array(row[1 : 1 + len(bands)]), np.zeros((len(bands), len(bands)))
    for (i, j), v in zip(pairs, row[1 + len(bands) :], strict=True):
        cov[i, j] = cov[j, i] = v
    axis = np.linalg.eigh(cov)[1][:, -1]
    axis = axis if axis[0] >= 0 else -axis
    along = sum(((F.col(b) - float(m)) * float(a) for b, m, a in zip(bands, mean, axis, strict=True)), F.lit(0.0))
    ends = exact_quantiles(known, {"v": along}, {"_sand": ("v", sand), "_grass": ("v", grass)})
    rows = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.lit(float(m)).alias("m"), F.lit(float(a)).alias("a")) for b, m, a in zip(bands, mean, axis, strict=True))))
    return ends.withColumn("_b", rows).select("_b.band", *(clip(F.col(f"_{n}") * F.col("_b.a") + F.col("_b.m"), 0.0, 1.0).alias(n) for n in ("sand", "grass")))


def scene_endmembers(training: DataFrame, bands: list[str], kd: dict[str, float], ku: dict[str, float], deep: dict[str, float], depth: str = "depth_m", deepest: float = 10.0) -> DataFrame | None:
    """Endmembers of a scene from shallow training samples whose water column is taken off."""
    z = F.abs(depth)
    shallow = training.where(z <= deepest)
    return bottom_endmembers(shallow.select(*(bottom_reflectance(F.col(b), F.lit(deep[b]), path_attenuation(F.lit(kd[b]), F.lit(ku[b]), z)).alias(b) for b in bands)), bands)


def block_strategies(df: DataFrame, folds: int = 5, size_m: float = 300.0) -> dict[str, DataFrame]:
    """Folds by blocks, by clusters and by bisection, to be compared."""
    df = checkpointed(df)  # read by each round of the clusterings
    return {"blocks": block_folds(df, size_m, folds), "clusters": cluster_folds(df, folds), "bisection": cluster_folds(df, folds, hierarchical=True)}

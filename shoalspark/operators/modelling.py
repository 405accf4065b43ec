"""Accuracy, folds, alignment and depth models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalspark.operators.joins import any_within
from shoalspark.operators.quantiles import exact_quantiles, with_quantiles
from shoalspark.session import checkpointed, shared_path


def accuracy(truth: Column, predicted: Column) -> list[Column]:
    """RMSE, MAE, bias, R2 and n as aggregates."""
    e = predicted - truth
    n = F.count(e)
    sst = F.var_pop(F.when(e.isNotNull(), truth)) * n
    return [
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        F.when(sst > 0, 1 - F.sum(e * e) / sst).alias("r2"), n.alias("n"),
    ]


def depth_summary(df: DataFrame, depth: str = "depth_m") -> DataFrame:
    """Count, nine percentiles and sign shares of a depth column."""
    ps = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
    p = exact_quantiles(df, {"d": F.col(depth)}, {f"p{round(q * 100):02d}": ("d", q) for q in ps})
    return with_quantiles(df.agg(F.count(depth).alias("n"), F.min(depth).alias("least"), F.max(depth).alias("most"), F.avg((F.col(depth) < 0).cast("double")).alias("negative")), p)


def depth_histogram(df: DataFrame, depth: str = "depth_m", width: float = 1.0) -> DataFrame:
    return df.where(F.col(depth).isNotNull()).groupBy(F.floor(F.abs(depth) / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``(i, edge)``: edges of ``bins`` equally full bins, the least and largest value included."""
    edges = exact_quantiles(df, {"v": F.col(value)}, {f"e{i}": ("v", i / bins) for i in range(bins + 1)})
    return edges.select(F.posexplode(F.array(*(F.col(f"e{i}") for i in range(bins + 1)))).alias("i", "edge"))


def depth_bins(df: DataFrame, truth: str, predicted: str, width: float = 0.5) -> DataFrame:
    """Accuracy by bin of true depth, with the bin's lower end and upper end."""
    b = F.floor(F.abs(truth) / width).cast("int")
    return df.groupBy(b.alias("bin")).agg(*accuracy(F.col(truth), F.col(predicted))).withColumn("lo", F.col("bin") * width).withColumn("hi", (F.col("bin") + 1) * width)


def residual_summary(df: DataFrame, residual: str) -> DataFrame:
    size = F.abs(residual)
    q = checkpointed(exact_quantiles(df, {"e": F.col(residual), "s": size}, {"median": ("e", 0.5), "p90": ("s", 0.9), "p99": ("s", 0.99)}))
    apart = df.crossJoin(F.broadcast(q.select(F.col("median").alias("_m"))))  # one row
    mad = exact_quantiles(apart, {"a": F.abs(F.col(residual) - F.col("_m"))}, {"mad": ("a", 0.5)})
    one = df.agg(F.count(residual).alias("n"), F.avg(residual).alias("mean"), F.sqrt(F.avg(F.col(residual) * F.col(residual))).alias("rmse"))
    return with_quantiles(with_quantiles(one, q), mad).select("n", "median", "mean", "mad", "rmse", "p90", "p99")


def coverage_grid(df: DataFrame, n: int = 10, least: int = 10) -> DataFrame:
    """Occupied cells of an n x n grid over the points' extent, with counts of the others as 0."""
    box = df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    # an extent of no width puts all points into the first cells
    at = lambda c, lo, hi: F.least(F.lit(n - 1), F.coalesce(F.floor(F.try_divide(F.col(c) - F.col(lo), F.col(hi) - F.col(lo)) * n), F.lit(0))).cast("int")
    count = df.crossJoin(F.broadcast(box)).groupBy(at("y", "y0", "y1").alias("gr"), at("x", "x0", "x1").alias("gc")).agg(F.count(F.lit(1)).alias("k"))
    cells = df.sparkSession.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("gr"), (F.col("id") % n).cast("int").alias("gc"))
    return cells.join(count, ["gr", "gc"], "left").select("gr", "gc", F.coalesce("k", F.lit(0)).alias("n"), (F.coalesce("k", F.lit(0)) >= least).alias("covered"))


def stratified_split(df: DataFrame, id_col: str, target: str, strata: int = 20, share: float = 0.2) -> DataFrame:
    """Quantile strata of the target; of each, the rows whose percent rank in an order made of the ids is below ``share`` are the test set.

    A stratum of one row joins the largest one. Counts of the order's 10,007 keys tell the key that a stratum's
    test set ends in; only the rows of that key are numbered. Rows without a target are in the first stratum.
    """
    cuts = checkpointed(quantile_edges(df, target, strata).where((F.col("i") > 0) & (F.col("i") < strata)).agg(F.sort_array(F.collect_list("edge")).alias("_q")))  # one row
    binned = df.crossJoin(F.broadcast(cuts)).withColumn("_own", F.expr(f"size(filter(_q, q -> q < {target}))")).drop("_q")
    binned = binned.withColumn("_key", F.coalesce(F.pmod(F.col(id_col) * 7919 + 42, F.lit(10007)), F.lit(-1)))
    count = checkpointed(binned.groupBy("_own", "_key").agg(F.count(F.lit(1)).alias("_n")))  # strata x 10,008 rows at most
    sizes = count.groupBy("_own").agg(F.sum("_n").alias("_all"))
    largest = sizes.agg(F.max_by("_own", F.struct("_all", -F.col("_own"))).alias("_largest"))  # one row
    merged = sizes.crossJoin(F.broadcast(largest)).select("_own", F.when(F.col("_all") < 2, F.col("_largest")).otherwise(F.col("_own")).alias("stratum"))
    keys = count.join(F.broadcast(merged), "_own").groupBy("stratum", "_key").agg(F.sum("_n").alias("_n"))
    whole = Window.partitionBy("stratum")
    keys = keys.withColumns({"_all": F.sum("_n").over(whole), "_to": F.sum("_n").over(whole.orderBy("_key"))}).withColumn("_from", F.col("_to") - F.col("_n"))
    rank = lambda before: F.coalesce(F.try_divide(before, F.col("_all") - 1), F.lit(0.0)) < share
    sure = F.when(rank(F.col("_to") - 1), True).when(~rank(F.col("_from")), False)
    marks = merged.join(keys.withColumn("_sure", sure).select("stratum", "_key", "_from", "_all", "_sure"), "stratum")
    marked = binned.join(F.broadcast(marks), ["_own", "_key"])
    at = F.rank().over(Window.partitionBy("stratum", "_key").orderBy(id_col)) - 1
    ends = marked.where(F.col("_sure").isNull()).withColumn("is_test", rank(F.col("_from") + at))
    return marked.where(F.col("_sure").isNotNull()).withColumn("is_test", F.col("_sure")).unionByName(ends).select(*df.columns, "stratum", "is_test")


def block_folds(df: DataFrame, size_m: float, folds: int) -> DataFrame:
    """Blocks of the plane dealt over folds."""
    bx, by = F.floor(F.col("x") / size_m).cast("long"), F.floor(F.col("y") / size_m).cast("long")
    return df.withColumn("fold", F.pmod(bx * 31 + by * 17, F.lit(folds)).cast("int"))


def track_folds(df: DataFrame, most: int) -> DataFrame:
    """Tracks, largest first, as folds of their own; the rest train only."""
    n = df.groupBy("track").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "track").limit(most)
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("n").desc(), "track")  # at most ``most`` rows
    return n.withColumn("fold", F.row_number().over(w) - 1)


def buffered_train(df: DataFrame, fold: int, radius: float) -> DataFrame:
    """Training rows of a fold: those farther than ``radius`` from each of its test rows."""
    test = df.where(F.col("fold") == fold).select(F.col("x").alias("rx"), F.col("y").alias("ry")).distinct()
    train = df.where(F.col("fold") != fold)
    near = any_within(train, test, radius, ["point_id"])
    return train.join(near, "point_id", "left_anti")


def cluster_quality(df: DataFrame, label: str = "cluster") -> DataFrame:
    """One row: mean distance to the own centre (compactness), least distance of two centres (separation), and the silhouette.

    The silhouette is that of squared distances, whose means follow from each cluster's sums, so that all rows
    count and no two rows meet; only the table of centres, one row a cluster, is joined.
    """
    centre = df.groupBy(label).agg(
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("k"), (F.var_pop("x") + F.var_pop("y")).alias("spread"),
    )
    c = centre.withColumnRenamed(label, "_of")
    other = c.select(F.col("_of").alias("_to"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    apart = c.join(other, F.col("_of") < F.col("_to")).agg(F.min(F.hypot(F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy"))).alias("separation"))
    own = df.select(F.monotonically_increasing_id().alias("_row"), F.col(label).alias("_mine"), "x", "y")
    both = own.crossJoin(F.broadcast(c)).withColumn("d2", F.pow(F.col("x") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("cy"), F.lit(2.0)))
    mean2 = F.col("d2") + F.col("spread")
    mine = F.col("_mine") == F.col("_of")
    inside = F.when(mine & (F.col("k") > 1), mean2 * F.col("k") / (F.col("k") - 1))
    per_row = both.groupBy("_row", "_mine").agg(F.max(inside).alias("a"), F.min(F.when(~mine, mean2)).alias("b"), F.max(F.when(mine, F.sqrt("d2"))).alias("d"))
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    per_cluster = per_row.groupBy("_mine").agg(F.avg("d").alias("d"), F.sum(s).alias("s"), F.count(F.lit(1)).alias("n"))
    one = per_cluster.agg(F.avg("d").alias("compactness"), (F.sum("s") / F.sum("n")).alias("silhouette"))
    return one.crossJoin(F.broadcast(apart))


def index_line(df: DataFrame, index: str, depth: str) -> DataFrame:
    return df.agg(F.regr_slope(depth, index).alias("slope"), F.regr_intercept(depth, index).alias("intercept"), F.regr_r2(depth, index).alias("r2"))


SHIFT_EDGES = (0.0, 2.0, 5.0, 10.0, 20.0, 30.0, 40.0)


def depth_bin_of(depth: Column, edges: tuple[float, ...] = SHIFT_EDGES) -> Column:
    """Index of the left-closed bin; null outside the edges."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (depth >= lo) & ((depth < hi) if hi != edges[-1] else (depth <= hi))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def bin_shifts(df: DataFrame, depth: str, residual: str) -> DataFrame:
    """Median residual of each depth bin."""
    binned = df.withColumn("bin", depth_bin_of(F.abs(depth))).where(F.col("bin").isNotNull())
    middle = exact_quantiles(binned, {"r": F.col(residual)}, {"shift": ("r", 0.5)}, ("bin",))
    return with_quantiles(binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), middle, ("bin",)).select("bin", "shift", "n")


def huber_weight(u: Column, c: float = 1.0) -> Column:
    return F.when(F.abs(u) > c, c / F.abs(u)).otherwise(1.0)


def planar_shift(df: DataFrame, residual: str, c: float = 1.0, rounds: int = 20) -> tuple[float, float, float]:
    """Plane a + b x + c y through residuals by reweighted least squares; each round one row of sums reaches the driver."""
    centre = df.agg(F.avg("x"), F.avg("y")).first()
    d = df.select((F.col("x") - centre[0]).alias("u"), (F.col("y") - centre[1]).alias("v"), F.col(residual).alias("r")).where(F.col("r").isNotNull()).cache()
    beta = np.zeros(3)
    for i in range(rounds):
        e = F.col("r") - (beta[0] + beta[1] * F.col("u") + beta[2] * F.col("v"))
        scale = 1.4826 * (exact_quantiles(d, {"a": F.abs(e)}, {"mad": ("a", 0.5)}).first()[0] or 0.0)
        w = huber_weight(e / max(scale, 1e-9), c) if i else F.lit(1.0)
        w = w * w  # rows and targets both carry the weight
        terms = [F.lit(1.0), F.col("u"), F.col("v")]
        sums = d.agg(*(F.sum(w * a * b) for j, a in enumerate(terms) for b in terms[j:]), *(F.sum(w * a * F.col("r")) for a in terms)).first()
        m = np.array([[sums[0], sums[1], sums[2]], [sums[1], sums[3], sums[4]], [sums[2], sums[4], sums[5]]])
        new = np.linalg.lstsq(m, np.array(sums[6:9]), rcond=None)[0]
        if np.allclose(new, beta, atol=1e-9):
            break
        beta = new
    d.unpersist()
    return float(beta[0] - beta[1] * centre[0] - beta[2] * centre[1]), float(beta[1]), float(beta[2])


def fit_depth_model(train: DataFrame, features: list[str], target: str, trees: int = 40, depth: int = 12, weight: str | None = None, seed: int = 42):
    """Random forest over complete rows; returns the assembler and the model."""
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    forest = RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol="predicted_m", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed)
    if weight:
        forest = forest.setWeightCol(weight)
    return assembler, forest.fit(assembler.transform(train.dropna(subset=[*features, target])))


#: Nodes of a forest up to which its tables are broadcast (32 bytes each); a larger one is asked tree by tree.
MOST_NODES = 8_000_000


def forest_nodes(model, spark: SparkSession) -> list[tuple[np.ndarray, ...]]:
    """``(feature, threshold, left, right, prediction)`` of each tree's nodes, as the saved model holds them; a leaf's feature is -1."""
    path = shared_path(spark, "forest")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    node = rows.schema["nodeData"].dataType if "nodeData" in rows.columns else None
    get = (lambda c: F.col(f"nodeData.{c}")) if node else F.col
    flat = rows.select("treeID", get("id").alias("id"), get("prediction").alias("p"), get("leftChild").alias("l"), get("rightChild").alias("r"), get("split.featureIndex").alias("f"), F.get(get("split.leftCategoriesOrThreshold"), F.lit(0)).alias("t"))
    pdf = flat.toPandas().sort_values(["treeID", "id"])  # as many rows as nodes, checked before
    trees = []
    for _, t in pdf.groupby("treeID", sort=True):
        leaf = t["l"].to_numpy() < 0
        trees.append((
            np.where(leaf, -1, t["f"].to_numpy()).astype(np.int32), np.where(leaf, 0.0, t["t"].to_numpy(float)), t["l"].to_numpy(np.int32), t["r"].to_numpy(np.int32), t["p"].to_numpy(float),
        ))
    return trees


def tree_values(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """Each tree's prediction (tree, row): all rows of a batch go down one level at a time; a leaf's rows stay where they are."""
    out = np.empty((len(trees), len(x)))
    cells, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for i, (feature, threshold, left, right, value) in enumerate(trees):
        inner, own = feature >= 0, np.arange(len(feature))
        column = np.where(inner, feature, 0).astype(np.intp)
        children = np.stack([np.where(inner, right, own), np.where(inner, left, own)], axis=1).ravel().astype(np.intp)
        at = np.zeros(len(x), np.intp)
        while inner.take(at).any():
            at = children.take(2 * at + (cells.take(first + column.take(at)) <= threshold.take(at)))
        out[i] = value.take(at)
    return out


def tree_spread(model, rows: DataFrame, features: list[str] | None = None) -> DataFrame:
    """``rows`` with the mean and standard deviation over all trees of a forest of continuous features; null where a feature is null or NaN.

    Features are columns, or the assembled ``features``. The forest's nodes are flat arrays, broadcast once, and
    Arrow batches go down all trees in one vectorised pass. A forest of more than ``MOST_NODES`` nodes
    isn't broadcast: its trees are asked on the JVM, ten columns at a time.
    """
    spark = rows.sparkSession
    x = [F.col(f).cast("double") for f in features] if features else [vector_to_array(F.col("features"))[i] for i in range(model.numFeatures)]
    if model.totalNumNodes > MOST_NODES:
        return _spread_tree_by_tree(model, rows, x)
    trees = spark.sparkContext.broadcast(forest_nodes(model, spark))

    @F.pandas_udf("mean double, std double")
    def spread(*columns: pd.Series) -> pd.DataFrame:
        at = np.stack([c.to_numpy(float) for c in columns], axis=1)  # nulls are NaN by now
        good = ~np.isnan(at).any(axis=1)
        each = tree_values(trees.value, at[good])  # the others, as masked pixels, don't go down the trees
        mean, std = np.full(len(at), np.nan), np.full(len(at), np.nan)
        mean[good], std[good] = each.mean(axis=0), each.std(axis=0)
        return pd.DataFrame({"mean": mean, "std": std})

    out = rows.withColumn("_spread", spread(*x))
    return out.withColumns({"tree_mean_m": F.nanvl("_spread.mean", F.lit(None)), "tree_std_m": F.nanvl("_spread.std", F.lit(None))}).drop("_spread")


def _spread_tree_by_tree(model, rows: DataFrame, x: list[Column]) -> DataFrame:
    known = F.lit(True)
    for c in x:
        known = known & c.isNotNull() & ~F.isnan(c)
    out = rows.withColumns({"_known": known, "_x": array_to_vector(F.array(*(F.when(known, c).otherwise(0.0) for c in x))), "_s1": F.lit(0.0), "_s2": F.lit(0.0)})
    trees = model.trees
    for first in range(0, len(trees), 10):
        some = trees[first : first + 10]
        for i, t in enumerate(some):
            out = t.setFeaturesCol("_x").setPredictionCol(f"_tree{i}").transform(out)
        each = [F.col(f"_tree{i}") for i in range(len(some))]
        sums = {"_s1": sum(each, F.col("_s1")), "_s2": sum((e * e for e in each), F.col("_s2"))}
        out = checkpointed(out.withColumns(sums).drop(*(f"_tree{i}" for i in range(len(some)))))
    mean = F.col("_s1") / len(trees)
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_s2") / len(trees) - mean * mean))
    return out.withColumns({"tree_mean_m": F.when(F.col("_known"), mean), "tree_std_m": F.when(F.col("_known"), std)}).drop("_s1", "_s2", "_x", "_known")


def training_bounds(df: DataFrame, features: list[str]) -> DataFrame:
    """p0.5 and p99.5 of each feature widened by a tenth of their range, one row a feature."""
    ends = {f"{side}_{f}": (f, q) for f in features for side, q in (("lo", 0.005), ("hi", 0.995))}
    one = exact_quantiles(df, {f: F.col(f) for f in features}, ends)
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"lo_{f}").alias("lo"), F.col(f"hi_{f}").alias("hi")) for f in features)))
    margin = 0.1 * (F.col("hi") - F.col("lo"))
    return one.select(rows.alias("b")).select("b.*").select("feature", (F.col("lo") - margin).alias("lo"), (F.col("hi") + margin).alias("hi"))


def applicability(bounds: dict[str, tuple[float, float]], k: float = 3.0) -> Column:
    """Mean over features of exp(-k d), d the distance outside the bounds over their range."""
    terms = []
    for f, (lo, hi) in bounds.items():
        d = F.greatest(F.lit(0.0), lo - F.col(f), F.col(f) - hi) / max(hi - lo, 1e-12)
        terms.append(F.exp(-k * d))
    return sum(terms[1:], terms[0]) / len(terms)


def physics_inversion(pixels: DataFrame, bands: list[str], deep: list[float], kd: list[float], ku: list[float], sand: list[float], grass: list[float], steps: int = 20) -> DataFrame:
    """Depth and sand share of each pixel by damped coordinate Gauss-Newton steps, vectorised over Arrow batches."""
    k = np.array(kd) + np.array(ku)
    r_deep, r_sand, r_grass = map(np.array, (deep, sand, grass))

    def run(batches):
        for pdf in batches:
            obs = pdf[bands].to_numpy(float)
            z, s = np.full(len(obs), 5.0), np.full(len(obs), 0.5)
            live = np.ones(len(obs), bool)
            for _ in range(steps):
                e = np.exp(-k * z[:, None])
                rho = s[:, None] * r_sand + (1 - s[:, None]) * r_grass
                res = obs - (r_deep * (1 - e) + rho / np.pi * e)
                live &= np.sqrt((res**2).mean(axis=1)) >= 1e-3
                jz = k * e * (r_deep - rho / np.pi)
                js = (r_sand - r_grass) / np.pi * e
                z = np.where(live, np.clip(z + (res * jz).sum(axis=1) / ((jz**2).sum(axis=1) + 0.01), 0.1, 30), z)
                s = np.where(live, np.clip(s + (res * js).sum(axis=1) / ((js**2).sum(axis=1) + 0.01), 0, 1), s)
            e = np.exp(-k * z[:, None])
            rho = s[:, None] * r_sand + (1 - s[:, None]) * r_grass
            rms = np.sqrt(((obs - (r_deep * (1 - e) + rho / np.pi * e)) ** 2).mean(axis=1))
            yield pd.DataFrame({"cell": pdf["cell"], "depth_m": z, "sand": s, "residual": rms, "sigma_m": np.clip(0.5 + 2 * rms / max(r_deep.mean(), 0.01) + 0.05 * z, 0.3, 5)})

    return pixels.select("cell", *bands).mapInPandas(run, "cell long, depth_m double, sand double, residual double, sigma_m double")

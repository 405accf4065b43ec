"""Depth-model training as a chain: features, outlier gate, split with all survey rows in training, weighted forest, bounds, supported depth."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.functions import optics
from shoalspark.operators import modelling
from shoalspark.operators.profiles import support_depth
from shoalspark.operators.quantiles import exact_quantiles
from shoalspark.operators.sections import sanitised
from shoalspark.operators.selection import clustered, line_residual_filter, tail_split
from shoalspark.session import checkpointed

BANDS = ("b02", "b03", "b04", "b08")


class Trained(NamedTuple):
    """``rows`` have ``is_test``, ``is_train`` and ``predicted_m``; ``limits`` is one row of depths that may cap predictions and the one chosen."""

    model: object
    features: list[str]
    bounds: dict[str, tuple[float, float]]
    line: tuple[float, float] | None
    rows: DataFrame
    funnel: DataFrame
    limits: DataFrame


def with_features(points: DataFrame, linf: dict[str, float], line: tuple[float, float] | None = None) -> DataFrame:
    """``points`` (bands) with the optical features and, where the line (slope, intercept) on the index is known, ``stumpf_depth``."""
    out = points.withColumns(optics.features(*(F.col(b) for b in BANDS), linf))
    return out if line is None else out.withColumn("stumpf_depth", line[0] * F.col("stumpf_idx") + line[1])


def final_depth(prefer: str, physics: Column, rmse: Column, p95: Column, given: Column) -> Column:
    """Struct (final_m, source): the depth of the preferred kind (physics, rmse, combined or training_p95), else what stands in for it.

    Combined is the lesser of physics and error, or the one that is known. The training depths' 95th percentile stands in for each, then the limit given, then 20 m;
    with ``training_p95`` missing, the limit given comes next too.
    """
    both = F.least(physics, rmse)
    kinds = {"physics": [("physics", physics), ("combined", both)], "rmse": [("rmse", rmse)], "combined": [("combined", both)], "training_p95": []}
    if prefer not in kinds:
        raise ValueError(f"no kind of depth limit {prefer}")
    ordered = [*kinds[prefer], ("training_p95", p95), ("given", given), ("default", F.lit(20.0))]
    return F.coalesce(*(F.when(c.isNotNull(), F.struct(c.cast("double").alias("final_m"), F.lit(n).alias("source"))) for n, c in ordered))


def full_bins(bins: DataFrame, width: float) -> DataFrame:
    """Depth bins from the first to the one after the last, empty ones with ``n`` 0; as many rows as bins."""
    ends = bins.agg(F.min("bin").alias("a"), (F.max("bin") + 1).alias("b")).where(F.col("a").isNotNull())
    every = ends.select(F.explode(F.sequence("a", "b")).alias("bin"))
    return every.join(bins.select("bin", "n", "rmse"), "bin", "left").select("bin", ((F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"), "rmse")


def train_depth_model(
    points: DataFrame, deepest: float, linf: dict[str, float] | None = None, groups: tuple[str, ...] = (), survey: str = "extra_xyz", split: str = "strata",
    target_rmse: float = 0.5, bin_m: float = 1.0, least: int = 200, physics_m: float | None = None, prefer: str = "combined", trees: int = 300, depth: int = 20, seed: int = 42,
) -> Trained:
    """A forest on points (point_id, x, y, source, sample_weight, depth_m, bands) that never sees its test rows.

    Rows far from a robust line of depth on the log-ratio index go (by ``groups``, where depths lie between 0.25 m and ``deepest``), then those
    with a feature, depth or weight that isn't finite (a missing weight is 1). Of the rows that aren't of ``survey``, a fifth by depth strata (``split``
    "strata"), or the one of five clusters whose deep end is most like the whole's ("clusters"), tests; all else trains, as far as it isn't deeper than
    ``deepest``. Without other rows the survey's are split. The index's line is fitted on training rows alone and adds a feature where 20 of
    them have the index. Depth of support comes from test bins with ``least`` rows. No rows are sampled.
    """
    z = F.abs("depth_m")
    start = with_features(points.withColumn("sample_weight", F.coalesce(F.col("sample_weight").cast("double"), F.lit(1.0))), linf or {})
    start = checkpointed(start.withColumns({"depth_pos": z, "_gate": F.when(z.between(0.25, deepest), z)}))
    gated = line_residual_filter(start, "point_id", "stumpf_idx", "_gate", groups)
    base = [*BANDS, *optics.features(*(F.col(b) for b in BANDS), {})]
    clean = checkpointed(sanitised(gated, [*base, "depth_pos", "sample_weight"]).drop("_gate"))
    is_survey = F.coalesce(F.col("source") == survey, F.lit(False))
    other = clean.where(~is_survey)
    if other.isEmpty():
        other, is_survey = clean, F.lit(False)
    if split == "strata":
        marks = modelling.stratified_split(other, "point_id", "depth_pos").select("point_id", "is_test")
    elif split == "clusters":
        marks = tail_split(clustered(other, 5, seed=seed), "depth_pos").select("point_id", "is_test")
    else:
        raise ValueError(f"no split {split}")
    rows = clean.join(marks.distinct(), "point_id", "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)) & ~is_survey)
    rows = checkpointed(rows.withColumn("is_train", ~F.col("is_test") & (F.col("depth_pos") <= deepest)))
    train = rows.where("is_train")
    fitted = modelling.index_line(train, "stumpf_idx", "depth_pos").first()
    enough = train.limit(20).count() == 20 and fitted["slope"] is not None
    line = (float(fitted["slope"]), float(fitted["intercept"])) if enough else None
    features = base + (["stumpf_depth"] if line else [])
    rows = rows.withColumn("stumpf_depth", line[0] * F.col("stumpf_idx") + line[1]) if line else rows
    assembler, model = modelling.fit_depth_model(rows.where("is_train"), features, "depth_pos", trees, depth, "sample_weight", seed)
    scored = checkpointed(model.transform(assembler.transform(rows)).drop("features"))
    bounds = {r["feature"]: (r["lo"], r["hi"]) for r in modelling.training_bounds(scored, features).collect()}  # one row a feature
    test = scored.where(F.col("is_test") & (F.col("depth_pos") <= deepest))
    support = support_depth(full_bins(modelling.depth_bins(test, "depth_pos", "predicted_m", bin_m), bin_m), target_rmse, least)
    deep_end = exact_quantiles(scored, {"d": F.col("depth_pos")}, {"training_p95_m": ("d", 0.95)})
    one = support.crossJoin(F.broadcast(deep_end)).withColumn("physics_m", F.lit(physics_m).cast("double"))  # one row each
    chosen = final_depth(prefer, F.col("physics_m"), F.col("strict_m"), F.col("training_p95_m"), F.lit(deepest))
    counts = start.agg(F.count(F.lit(1)).alias("points")).crossJoin(gated.agg(F.count(F.lit(1)).alias("near_line")))  # one row each
    counts = counts.crossJoin(scored.agg(F.count(F.lit(1)).alias("complete"), F.count_if("is_train").alias("train"), F.count_if("is_test").alias("test")))
    return Trained(model, features, bounds, line, scored, counts, one.withColumn("_f", chosen).select("strict_m", "relaxed_m", "physics_m", "training_p95_m", "_f.final_m", "_f.source"))


def accuracy_by_layer(trained: Trained) -> DataFrame:
    """Accuracy of training and test rows, overall (null) and by source."""
    layers = F.when(F.col("is_test"), "test").when(F.col("is_train"), "train")
    rows = trained.rows.withColumn("layer", layers).where(F.col("layer").isNotNull())
    grouped = rows.groupingSets([[F.col("layer")], [F.col("layer"), F.col("source")]], "layer", "source")
    return grouped.agg(*modelling.accuracy(F.col("depth_pos"), F.col("predicted_m")))

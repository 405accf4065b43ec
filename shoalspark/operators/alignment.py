"""Predictions against tie points, their shift, masks after prediction, and depth caps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.functions import optics
from shoalspark.operators.joins import sampled_at
from shoalspark.operators.modelling import accuracy, bin_shifts, depth_bin_of
from shoalspark.operators.quantiles import exact_quantiles, with_quantiles


def wet_pixels(cells: DataFrame, nir_max: float = 0.03) -> DataFrame:
    """Cells whose bands are all known and above 0.001, and whose near infrared is below three times its deep-water limit."""
    visible = [F.col(b) > 0.001 for b in ("b02", "b03", "b04")]
    return cells.where((F.col("b08") < 3 * nir_max) & visible[0] & visible[1] & visible[2])


def bright_masked(cells: DataFrame, depth: str, limit: float, shallow_nir: float | None = 0.03) -> DataFrame:
    """Depth is null where blue is above the limit; cells dark in the near infrared (shallow sand) keep theirs unless ``shallow_nir`` is None."""
    bad = F.coalesce(F.col("b02") > limit, F.lit(False))
    if shallow_nir is not None:
        bad = bad & ~F.coalesce(F.col("b08") < shallow_nir, F.lit(False))
    return cells.withColumn(depth, F.when(~bad, F.col(depth)))


def funnel(cells: DataFrame, steps: dict[str, str]) -> DataFrame:
    """Cells that pass the first step, the first two, and so on; one row a step, in one pass."""
    passed, counts = F.lit(True), []
    for name, rule in steps.items():
        passed = passed & F.coalesce(F.expr(rule), F.lit(False))
        counts.append(F.struct(F.lit(name).alias("step"), F.count_if(passed).alias("n")))
    return cells.agg(F.array(F.struct(F.lit("all").alias("step"), F.count(F.lit(1)).alias("n")), *counts).alias("_s")).select(F.posexplode("_s").alias("rank", "_e")).select("rank", "_e.*")


def gated_residuals(df: DataFrame, residual: str, most: float, least: int = 50) -> DataFrame:
    """Rows with a residual of at most ``most``, if there are enough of them; else all with one."""
    known = df.where(F.col(residual).isNotNull())
    n = known.agg(F.count_if(F.abs(residual) <= most).alias("_n"))  # one row
    return known.crossJoin(F.broadcast(n)).where((F.col("_n") < max(10, least)) | (F.abs(residual) <= most)).drop("_n")


def raster_accuracy(points: DataFrame, cells: DataFrame, predicted: str, x0: float, y0: float, size: float, deepest: float | None = None) -> DataFrame:
    """Accuracy of a raster of positive depths under the points, overall and by source (null: all)."""
    at = sampled_at(points.withColumn("_z", F.abs("depth_m")), cells, [predicted], x0, y0, size).where(F.col(predicted).isNotNull())
    at = at if deepest is None else at.where(F.col("_z") <= deepest)
    return at.rollup("source").agg(*accuracy(F.col("_z"), F.col(predicted)))


def aligned_raster(cells: DataFrame, points: DataFrame, predicted: str, x0: float, y0: float, size: float) -> tuple[DataFrame, DataFrame]:
    """Cells with the median residual of their predicted depth's bin taken off, and accuracy at the tie points before and after.

    The bins are a handful of rows; one without tie points shifts by nothing.
    """
    shifted = lambda d: d.withColumn("_bin", depth_bin_of(F.col(predicted))).join(F.broadcast(shifts), "_bin", "left").withColumn("aligned", F.col(predicted) - F.coalesce("_shift", F.lit(0.0))).drop("_bin", "_shift")
    ties = sampled_at(points.withColumn("_z", F.abs("depth_m")), cells, [predicted], x0, y0, size).where(F.col(predicted).isNotNull())
    shifts = bin_shifts(ties.withColumn("_e", F.col(predicted) - F.col("_z")), predicted, "_e").select(F.col("bin").alias("_bin"), F.col("shift").alias("_shift"))
    long = shifted(ties).select("_z", F.explode(F.array(*(F.struct(F.lit(n).alias("stage"), F.col(c).alias("p")) for n, c in (("before", predicted), ("after", "aligned"))))).alias("e")).select("_z", "e.*")
    return shifted(cells), long.groupBy("stage").agg(*accuracy(F.col("_z"), F.col("p")))


def depth_cap(cells: DataFrame, rmse_cap: float | None = None, factor: float = 2.3, cap: float = 50.0) -> DataFrame:
    """One row: median attenuation of the wet cells, the depth it lets see, and the lesser of it and the cap by error, with what limits."""
    wet = wet_pixels(cells)
    kd = with_quantiles(wet.agg(F.count(F.lit(1)).alias("n")), exact_quantiles(wet, {"k": optics.attenuation(F.col("b02"), F.col("b03"))}, {"kd": ("k", 0.5)}))
    physics = optics.depth_limit(F.col("kd"), factor, cap)
    error = F.lit(rmse_cap).cast("double")
    limit = F.when(physics.isNull() & error.isNull(), "none").when(error.isNull() | (physics <= error), "light").otherwise("error")
    return kd.select("kd", "n", physics.alias("physics_m"), F.least(physics, error).alias("cap_m"), limit.alias("limited_by"))


def soundings_usage(points: DataFrame) -> DataFrame:
    """Count, extent and depth range of each source."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("x", "y", "depth_m") for f, n in ((F.min, "min"), (F.max, "max"))]
    return points.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *ends)

"""Chains of operators from their first tables to a product: training diversity, optical composite, river depth, scene prediction."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.functions import optics, uncertainty
from shoalspark.functions.optics import clip
from shoalspark.operators import alignment, modelling, pixels, rivers, surveys
from shoalspark.operators.quantiles import exact_quantiles
from shoalspark.session import checkpointed

# -- diversity of a training set


def diversity(points: DataFrame, features: list[str], deepest: int = 20, grid: int = 10, least: int = 10) -> DataFrame:
    """One row: scores of the spread over space, depth, spectrum and passes (track and day), their blend, and advice.

    Space: share of grid cells with ``least`` points. Depth: metre bins with as
    many, over the bins down to the deepest point. Spectrum: mean of twice the
    features' variation, each at most 1. Passes: tenths, at most 1.
    """
    space = modelling.coverage_grid(points, grid, least).agg(F.avg(F.col("covered").cast("double")).alias("spatial"), F.count_if(~F.col("covered")).alias("empty_cells"))
    z = F.abs("depth_m")
    bins = points.where((z > 0) & (z <= deepest)).groupBy(F.least(F.floor(z), F.lit(deepest - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    filled = bins.agg(F.count_if(F.col("n") >= least).alias("_full"))
    reach = points.agg(F.ceil(F.max(z)).alias("_reach"))
    spread = [clip(2 * F.stddev_pop(f) / (F.avg(F.abs(f)) + 1e-6), None, 1.0) for f in features]
    spectral = points.agg((sum(spread, F.lit(0.0)) / len(features)).alias("spectral") if features else F.lit(0.5).alias("spectral"))
    day = points.groupBy("track", F.to_date("ts").alias("_day")).agg(F.count(F.lit(1)).alias("n"))
    passes = day.agg(F.count(F.lit(1)).alias("passes"), (F.max("n") / F.sum("n")).alias("top_share"))
    one = space
    for part in (filled, reach, spectral, passes):  # each of one row
        one = one.crossJoin(F.broadcast(part))
    one = one.withColumn("depth", F.col("_full") / F.greatest("_reach", F.lit(1))).drop("_full", "_reach")
    one = one.withColumn("score", 0.3 * F.col("spatial") + 0.3 * F.col("depth") + 0.2 * F.col("spectral") + 0.2 * F.least(F.col("passes") / 10, F.lit(1.0)))
    advice = (
        (F.col("spatial") < 0.5, "most of the area has no training points"), ((F.col("spatial") >= 0.5) & (F.col("spatial") < 0.8), "parts of the area have no training points"),
        (F.col("depth") < 0.5, "few depths are covered"), (F.col("passes") < 3, "too few passes"), ((F.col("passes") >= 3) & (F.col("passes") < 5), "more passes would help"),
        (F.col("top_share") > 0.5, "one pass dominates"), (F.col("spectral") < 0.4, "little optical variety"),
    )
    told = F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in advice)))
    return one.withColumn("advice", F.concat_ws("; ", F.when(F.size(told) == 0, F.array(F.lit("nothing is missing"))).otherwise(told)))


def diversity_gaps(points: DataFrame, top: int = 5, grid: int = 10, least: int = 10) -> DataFrame:
    """Where to add tracks: the ``top`` longest depth gaps and as many of the emptiest cells."""
    depth = surveys.depth_gaps(points, least=least).orderBy((F.col("to_m") - F.col("from_m")).desc(), "from_m").limit(top)
    cells = modelling.coverage_grid(points, grid, least).where(~F.col("covered")).orderBy("n", "gr", "gc").limit(top)
    a = depth.select(F.lit("depth").alias("kind"), F.col("from_m").cast("int").alias("first"), F.col("to_m").cast("int").alias("second"))
    return a.unionByName(cells.select(F.lit("cell").alias("kind"), F.col("gr").alias("first"), F.col("gc").alias("second")))


# -- optical composite


def optical_composite(scenes: DataFrame, stack: DataFrame, bands: list[str], most_cloud: float = 20.0, dates: int = 10, bad: tuple[int, ...] = (0, 3, 8, 9, 10, 11)) -> DataFrame:
    """Scenes (tile, day_no, cloud) choose the dates, the stack of their pixels gives medians over clear water.

    Dates: cloud at most ``most_cloud``, those that the most tiles share, by mean
    cloud; then those whose pixels are outliers go, unless all would. A cell
    without a clear date has null bands.
    """
    best = scenes.where(F.col("cloud") <= most_cloud).groupBy("tile", "day_no").agg(F.min("cloud").alias("cloud"))
    chosen = best.groupBy("day_no").agg(F.count(F.lit(1)).alias("tiles"), F.avg("cloud").alias("cloud")).orderBy(F.col("tiles").desc(), F.round("cloud", 6), "day_no").limit(dates)
    held = stack.join(F.broadcast(chosen.select("day_no")), "day_no", "left_semi")  # at most ``dates`` rows
    judged = pixels.outlier_dates(pixels.date_metrics(held, bad)).select("day_no", "outlier")
    some = judged.agg(F.coalesce(F.bool_or(~F.col("outlier")), F.lit(False)).alias("_some"))
    good = judged.crossJoin(F.broadcast(some)).where(~F.col("outlier") | ~F.col("_some")).select("day_no")
    clear = held.join(F.broadcast(good), "day_no", "left_semi")
    ok = ~F.col("scl").isin(*bad)
    out = clear.groupBy("prow", "pcol").agg(*(F.median(F.when(ok, F.col(b))).alias(b) for b in bands), F.count_if(ok).alias("clear_dates"))
    return out


# -- river depth


def river_depths(sections: DataFrame, measurements: DataFrame, soundings: DataFrame | None = None, **settings) -> DataFrame:
    """Depth and bed of sections whose level and banks are known, and what they rest on; see ``rivers.calibrated_depths``."""
    return rivers.calibrated_depths(sections, measurements, soundings, **settings).select("xs_id", "river_id", "s_center_m", "depth_source", "depth_raw_m", "depth_m", "bed_m")


# -- scenes


def predicted_with_uncertainty(cells: DataFrame, depth: Column, mode: str, kd: Column, trained_max: float, outside: Column | None = None, distance_m: Column | None = None, spread: Column | None = None) -> DataFrame:
    """``cells`` with depth_pred_m, sigma_m and confidence; ``mode`` is calibrated, transfer, physics or uncalibrated."""
    z = F.col("depth_pred_m")
    none = F.lit(0.0)
    sigma = uncertainty.combined_sigma(
        uncertainty.model_variance(mode, spread), uncertainty.optical_variance(kd, z), uncertainty.depth_variance(z), uncertainty.extrapolation_variance(z, trained_max, none if outside is None else outside),
        uncertainty.spatial_variance(none if distance_m is None else distance_m), uncertainty.input_variance(),
    )
    out = cells.withColumn("depth_pred_m", depth).withColumn("sigma_m", sigma)
    return out.withColumn("confidence", uncertainty.confidence(F.col("sigma_m"), z, kd, trained_max))


def scene_prediction(
    cells: DataFrame, model, features: list[str], bounds: dict[str, tuple[float, float]], trained_max: float, kd: Column, valid: Column, physical: Column | None = None,
    mode: str = "calibrated", limit_factor: float = 2.3, cap: float = 50.0, least_score: float = 0.5,
) -> tuple[DataFrame, DataFrame]:
    """``(scene, funnel)``: every cell with its depth (negative down) and uncertainty, or null, and how many cells pass each step.

    Steps: validity of the pixel, known features, the forest's mean and spread over all its trees, likeness to the training
    data (below ``least_score`` a cell counts as outside, which widens its sigma), the pull to ``physical`` beyond the trained
    depths, positive depth, depth within ``limit_factor`` over attenuation and ``cap``.
    """
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    ok = cells.withColumns({"_valid": F.coalesce(valid, F.lit(False)), "_known": known, "score": modelling.applicability(bounds)})
    told = modelling.tree_spread(model, ok.withColumns({f"_f{i}": F.when(F.col("_valid") & F.col("_known"), F.col(f)) for i, f in enumerate(features)}), [f"_f{i}" for i in range(len(features))])
    told = told.drop(*(f"_f{i}" for i in range(len(features))))
    depth = F.col("tree_mean_m") if physical is None else optics.hybrid_depth(F.col("tree_mean_m"), F.col("tree_std_m"), physical, trained_max)
    sure = predicted_with_uncertainty(told, depth, mode, kd, trained_max, outside=(F.col("score") < least_score).cast("double"), spread=F.col("tree_std_m"))
    z = F.col("depth_pred_m")
    marked = sure.withColumns({"_positive": F.coalesce(z > 0, F.lit(False)), "_within": F.coalesce(z <= optics.depth_limit(kd, limit_factor, cap), F.lit(False))})
    keep = F.col("_valid") & F.col("_known") & F.col("_positive") & F.col("_within")
    marked = checkpointed(marked.withColumns({"depth_m": F.when(keep, -z), "sigma_m": F.when(keep, F.col("sigma_m")), "confidence": F.when(keep, F.col("confidence"))}))
    steps = alignment.funnel(marked, {"valid": "_valid", "known": "_known", "positive": "_positive", "within_limit": "_within"})
    return marked.drop("_valid", "_known", "_positive", "_within", "depth_pred_m"), steps


def physics_scene(cells: DataFrame, sun_deg: float = 30.0, view_deg: float = 5.0, sand: tuple[float, ...] = (0.3, 0.35, 0.4), grass: tuple[float, ...] = (0.05, 0.1, 0.05)) -> DataFrame | None:
    """Depth of a scene by physics alone; None where it shows too little deep water.

    Two rows of scene statistics reach the driver: the deep reflectance and the median attenuation.
    """
    bands = ["b02", "b03", "b04"]
    deep = pixels.deep_reflectance(cells, bands).first()
    if deep["b02"] is None:
        return None
    kd = exact_quantiles(cells, {"k": optics.attenuation(F.col("b02"), F.col("b03"))}, {"k": ("k", 0.5)}).select(optics.slant(F.col("k"), F.lit(sun_deg)), optics.slant(F.col("k"), F.lit(view_deg))).first()
    steeper = (1.0, 1.2, 3.0)  # fixed values: attenuation of the bands over that of blue
    return modelling.physics_inversion(cells, bands, [deep[b] for b in bands], [kd[0] * s for s in steeper], [kd[1] * s for s in steeper], list(sand), list(grass))


def chunked_apply(cells: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, tile: int = 256, halo: int = 16) -> DataFrame:
    """``fn`` on each square tile with its halo; of its rows those of the tile's own cells stay (``schema`` has prow and pcol)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf.drop(columns=["tile_r", "tile_c", "inner"]))
        return out[(out["prow"] // tile == key[0]) & (out["pcol"] // tile == key[1])]

    return pixels.tiles_with_halo(cells, tile, halo).groupBy("tile_r", "tile_c").applyInPandas(run, schema)


def batched_apply(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` on each Arrow batch."""
    return df.mapInPandas(lambda batches: (fn(b) for b in batches), schema)


def cell_points(cells: DataFrame, value: str, x0: float, y0: float, size: float, step: int = 1) -> DataFrame:
    """Centres of the valid cells of every ``step``-th row and column."""
    kept = cells.where((F.col("prow") % step == 0) & (F.col("pcol") % step == 0) & F.col(value).isNotNull())
    return kept.select((x0 + (F.col("pcol") + 0.5) * size).alias("x"), (y0 - (F.col("prow") + 0.5) * size).alias("y"), F.col(value).alias("z"))


def stacked_mean(z: Column, weight: Column, count: Column) -> Column:
    """Mean surface of a stack that holds weighted sums; null where nothing was stacked."""
    return F.when((weight > 0) & (count > 0), z / weight / count)


def regional_settings(x: Column, y: Column, regions: list[tuple[tuple[float, float, float, float], dict[str, float]]], defaults: dict[str, float]) -> dict[str, Column]:
    """Each setting of the first region whose box (west, east, south, north) holds the place, over the defaults."""
    out = {}
    for name, default in defaults.items():
        c = F.lit(default)
        for (west, east, south, north), own in reversed(regions):
            c = F.when(x.between(west, east) & y.between(south, north), own.get(name, default)).otherwise(c)
        out[name] = c
    return out

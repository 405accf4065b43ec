"""Photons to picks and segments, along-track order, sampling and thinning of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalspark.operators import ordered
from shoalspark.session import checkpointed

# Sources by tier, weight, share retained and spacing in metres.
SOURCES = {
    "bathy_lidar": (1, 25.0, 0.85, 10.0), "multibeam": (1, 20.0, 0.80, 15.0), "high_quality_bag": (1, 15.0, 0.75, 20.0), "sonar_survey": (1, 12.0, 0.80, 15.0),
    "extra_xyz": (2, 10.0, 0.40, 30.0), "atl24": (2, 6.0, 0.30, 40.0), "atl_agreed": (2, 6.0, 0.30, 40.0), "atl03": (3, 3.0, 0.10, 60.0),
}
TRACK = ["granule", "beam"]


def source_value(source: Column, at: int, default: float) -> Column:
    names = F.create_map(*(F.lit(x) for k, v in SOURCES.items() for x in (k, float(v[at]))))
    return F.coalesce(F.try_element_at(names, source), F.lit(default))


def photon_bins(photons: DataFrame, lat_res: float, height_res: float, most: int = 5000) -> DataFrame:
    """Equal-width latitude and height bins of each track; the tracks' ranges are aggregated and joined, so that no track is sorted."""
    columns = (("latitude", lat_res, "lat_bin"), ("photon_height", height_res, "height_bin"))
    ranges = photons.groupBy(*TRACK).agg(*(f(c).alias(f"_{name}_{end}") for c, _, name in columns for f, end in ((F.min, "low"), (F.max, "high"))))
    out = photons.join(ranges, TRACK)
    for c, res, name in columns:
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        n = F.greatest(F.lit(1.0), F.least(F.lit(float(most)), F.rint((high - low) / res)))
        at = F.when(high > low, F.floor((F.col(c) - low) / ((high - low) / n))).otherwise(0)
        out = out.withColumn(name, F.least(at, n - 1).cast("int")).drop(f"_{name}_low", f"_{name}_high")
    return out


def surface_heights(binned: DataFrame, percentile: float = 0.75, window_m: float = 5.0, height_res: float = 0.25) -> DataFrame:
    """Surface of each latitude bin: the fullest height bin near the track's mode, if full enough."""
    count = binned.groupBy(*TRACK, "lat_bin", "height_bin").agg(F.count(F.lit(1)).alias("n"), F.median("photon_height").alias("height_m"))
    peak = count.groupBy(*TRACK, "lat_bin").agg(F.max("n").alias("n"))
    least = peak.groupBy(*TRACK).agg(F.greatest(F.lit(2.0), F.percentile("n", F.lit(percentile))).alias("least"))
    mode = count.groupBy(*TRACK, "height_bin").agg(F.sum("n").alias("n")).groupBy(*TRACK).agg(F.max_by("height_bin", F.struct("n", -F.col("height_bin"))).alias("mode_bin"))
    near = count.join(least, TRACK).join(mode, TRACK).where((F.col("n") >= F.col("least")) & (F.abs(F.col("height_bin") - F.col("mode_bin")) * height_res <= window_m))
    return near.groupBy(*TRACK, "lat_bin").agg(F.max_by(F.struct("height_bin", "height_m", "n"), F.struct("n", -F.col("height_bin"))).alias("s")).select(*TRACK, "lat_bin", F.col("s.height_bin").alias("surface_bin"), F.col("s.height_m").alias("surface_m"), F.col("s.n").alias("n_surface"))


def bottom_picks(binned: DataFrame, surface: DataFrame, height_res: float = 0.25, least: int = 2) -> DataFrame:
    """Bottom of each latitude bin: the fullest height bin below the surface."""
    below = binned.join(surface.select(*TRACK, "lat_bin", "surface_m"), [*TRACK, "lat_bin"]).where(F.col("photon_height") < F.col("surface_m") - 2 * height_res)
    count = below.groupBy(*TRACK, "lat_bin", "height_bin").agg(F.count(F.lit(1)).alias("n"), F.median("photon_height").alias("h"), F.first("surface_m").alias("surface_m"))
    best = count.groupBy(*TRACK, "lat_bin").agg(F.max_by(F.struct("n", "h", "surface_m"), F.struct("n", -F.col("height_bin"))).alias("b"), F.sum("n").alias("n_subsurface"))
    picked = best.select(*TRACK, "lat_bin", F.col("b.n").alias("n_bottom"), "n_subsurface", F.col("b.h").alias("bottom_m"), (F.col("b.h") - F.col("b.surface_m")).alias("depth_m"))
    return picked.withColumn("frac_bottom", F.col("n_bottom") / F.col("n_subsurface")).where(F.col("n_bottom") >= least)


def along_track(photons: DataFrame, segment_m: float = 5.0) -> DataFrame:
    """Distance run by each photon and its segment."""

    def steps(rows: DataFrame, w: Window) -> DataFrame:
        dy = (F.col("latitude") - F.lag("latitude").over(w)) * 111_320.0
        dx = (F.col("longitude") - F.lag("longitude").over(w)) * 111_320.0 * F.cos(F.radians("latitude"))
        return rows.withColumn("_step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))

    rows = ordered.windowed(ordered.placed(photons, TRACK, ["delta_time", "photon_height", "conf"]), 1, steps)
    run = ordered.running(rows, along_m=("sum", F.col("_step"))).withColumn("along_m", F.round("along_m", 6))
    return ordered.plain(run.withColumn("seg_id", F.floor(F.col("along_m") / segment_m)).drop("_step"))


def segments(photons: DataFrame, segment_m: float = 5.0, least: int = 2) -> DataFrame:
    """Medians of each along-track segment with at least ``least`` photons."""
    med = [F.median(c).alias(c) for c in ("latitude", "longitude", "photon_height", "conf", "delta_time")]
    return along_track(photons, segment_m).groupBy(*TRACK, "seg_id").agg(*med, F.count(F.lit(1)).alias("n_photons")).where(F.col("n_photons") >= least)


def weighted(points: DataFrame, first: float = 5.0, second: float = 1.0, survey: float = 10.0) -> DataFrame:
    """Default weights by source where there is none."""
    s = F.col("source")
    w = F.when(s == "atl03", first).when(s == "atl24", second).when(s == "extra_xyz", survey).when(s == "atl_agreed", first + second).otherwise(1.0)
    return points.withColumn("sample_weight", F.coalesce("sample_weight", w))


def composition(points: DataFrame) -> DataFrame:
    """Count, share, mean and total weight, and effective share of each source."""
    all_rows = Window.partitionBy(F.lit(1))  # over as many rows as there are sources
    g = points.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("sample_weight").alias("mean_weight"), F.sum("sample_weight").alias("total_weight"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(all_rows)).withColumn("effective_share", F.try_divide(F.col("total_weight"), F.sum("total_weight").over(all_rows)))


def thinned(points: DataFrame, cell_m: float, top: int = 1) -> DataFrame:
    """Best rows of each cell by source weight; the lesser id of equals."""
    w = Window.partitionBy(F.floor(F.col("x") / cell_m), F.floor(F.col("y") / cell_m)).orderBy(source_value(F.col("source"), 1, 1.0).desc(), "point_id")
    return points.withColumn("rank_in_cell", F.row_number().over(w)).where(F.col("rank_in_cell") <= top)


def densified(points: DataFrame, cell_m: float, target: int) -> DataFrame:
    """Rows cell by cell, one more of each at a time, up to ``target``; rows beyond it in a cell never leave their task."""
    w = Window.partitionBy("_cx", "_cy").orderBy(source_value(F.col("source"), 1, 1.0).desc(), "point_id")
    ranked = points.withColumns({"_cx": F.floor(F.col("x") / cell_m), "_cy": F.floor(F.col("y") / cell_m)}).withColumn("rank_in_cell", F.row_number().over(w)).where(F.col("rank_in_cell") <= target)
    return ranked.orderBy("rank_in_cell", "_cx", "_cy", "point_id").limit(target).drop("_cx", "_cy")


def tier_capped(points: DataFrame, target: int) -> DataFrame:
    """The first ``target`` rows by tier, then weight, then id."""
    tier, weight = source_value(F.col("source"), 0, 3.0), source_value(F.col("source"), 1, 1.0)
    return points.withColumn("tier", tier.cast("int")).orderBy("tier", (weight * F.coalesce("sample_weight", F.lit(1.0))).desc(), "point_id").limit(target)


def source_capped(points: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows a source, in an order made of the ids.

    Counts of the order's 10,007 keys tell the last key that a source reaches; only rows up to it are numbered, each key by itself.
    """
    keyed = points.withColumns({"_s": F.struct("source"), "_key": F.pmod(F.col("point_id") * 7919 + seed, F.lit(10007))})
    count = keyed.groupBy("_s", "_key").agg(F.count(F.lit(1)).alias("_n"))
    before = count.withColumn("_before", F.sum("_n").over(Window.partitionBy("_s").orderBy("_key")) - F.col("_n")).where(F.col("_before") < most).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_s", "_key").orderBy("point_id"))
    return keyed.join(before, ["_s", "_key"]).withColumn("_r", rank).where(F.col("_before") + F.col("_r") <= most).drop("_s", "_key", "_before", "_r")


def local_complexity(neighbours: DataFrame) -> DataFrame:
    """Spread, gradient and density of the depths around each point, from its ``knn`` rows (``depth_m``, ``ref_depth``, ``dist``)."""
    g = neighbours.groupBy("point_id").agg(
        F.stddev_pop("ref_depth").alias("spread"), F.max(F.abs(F.col("ref_depth") - F.col("depth_m")) / F.greatest("dist", F.lit(1.0))).alias("gradient"), F.avg("dist").alias("mean_dist")
    )
    score = 0.5 * F.least(F.lit(1.0), F.col("spread") / 5) + 0.3 * F.least(F.lit(1.0), F.col("gradient")) + 0.2 * F.least(F.lit(1.0), 10 / F.greatest("mean_dist", F.lit(1.0)))
    return g.withColumn("complexity", score)


def transects(points: DataFrame, k: int = 20, radius: float = 20.0, aligned: float = 0.9, share: float = 0.7, least: int = 9) -> DataFrame:
    """``(point_id, aligned_share, is_transect)``: whether most of the ``k`` - 1 nearest others lie along one direction.

    The main direction is that of the neighbours' second moments, in closed form. A point with
    fewer than ``least`` others is on no transect; others at its own place point nowhere.
    """
    from shoalspark.operators.joins import neighbour_lists

    right = points.select(F.col("point_id").alias("ref_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = neighbour_lists(points.select("point_id", "x", "y"), right, k, radius, "point_id", "ref_id")
    others = F.slice(F.filter("near", lambda m: m["ref_id"] != F.col("point_id")), 1, k - 1)
    steps = F.transform(others, lambda m: F.struct(m["dist"].alias("dist"), (m["rx"] - F.col("x")).alias("u"), (m["ry"] - F.col("y")).alias("v")))
    v = near.select("point_id", steps.alias("_to")).where(F.size("_to") > 0)  # a row a point: its neighbours stay in one list
    total = lambda f: F.aggregate("_to", F.lit(0.0), lambda t, m: t + f(m["u"], m["v"]))
    m = v.withColumn("_angle", 0.5 * F.atan2(2 * total(lambda a, b: a * b), total(lambda a, b: a * a - b * b))).withColumns({"du": F.cos("_angle"), "dv": F.sin("_angle")})
    along = F.filter("_to", lambda m: (F.abs(m["u"] * F.col("du") + m["v"] * F.col("dv")) > aligned * m["dist"]) & (m["dist"] > 0))
    out = m.select("point_id", F.size("_to").alias("_n"), (F.size(along) / F.size("_to")).alias("aligned_share"))
    flagged = out.select("point_id", "aligned_share", ((F.col("_n") >= least) & (F.col("aligned_share") > share)).alias("is_transect"))
    return points.select("point_id").join(flagged, "point_id", "left").withColumn("is_transect", F.coalesce("is_transect", F.lit(False)))


def fused_training_table(points: DataFrame, radius: float = 30.0, tolerance: float = 1.5) -> DataFrame:
    """Conflict filter, collocation, union and weights of the altimeter and survey sources."""
    from shoalspark.operators.joins import collocated, reference_conflicts_removed

    cols = ["point_id", "x", "y", "depth_m", "source", "sample_weight"]
    of = lambda s: points.where(F.col("source") == s).select(cols)
    survey = of("extra_xyz")
    # each is read by several branches of the collocation
    first = checkpointed(reference_conflicts_removed(of("atl03"), survey, radius, tolerance).select(cols))
    second = checkpointed(reference_conflicts_removed(of("atl24"), survey, radius, tolerance).select(cols))
    return weighted(collocated(first, second).unionByName(survey))

"""Masks and environment filters: their meaning is read off one row of counts, never off a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.functions.optics import visible_class
from shoalspark.operators.ingest import finite
from shoalspark.operators.pixels import CELL, dilated, eroded

TINY = 1e-6


def value_at(points: DataFrame, pixels: DataFrame, column: str, x0: float, y0: float, size: float, name: str = "mask") -> DataFrame:
    """Points with the value of the cell that they lie in, as ``name``; null outside the grid."""
    keyed = points.withColumns({"prow": F.floor((y0 - F.col("y")) / size).cast("int"), "pcol": F.floor((F.col("x") - x0) / size).cast("int")})
    return keyed.join(pixels.select(*CELL, F.col(column).cast("double").alias(name)), CELL, "left").drop(*CELL)


def _profile(df: DataFrame, column: str, water: float) -> DataFrame:
    """One row: what values a mask column holds."""
    v = F.when(finite(column), F.col(column))
    return df.agg(
        F.count(v).alias("_n"), F.min(v).alias("_low"), F.max(v).alias("_high"), F.count_if(F.abs(v) <= TINY).alias("_n0"), F.count_if(F.abs(v - 1) <= TINY).alias("_n1"), F.count_if(v == water).alias("_nw"),
    )


_PROFILE = ("_n", "_low", "_high", "_n0", "_n1", "_nw")


def mask_filtered(points: DataFrame, column: str = "mask", kind: str = "auto", water: float = 0.0, invert: bool = False, threshold: float = 0.5) -> DataFrame:
    """Points on water by a sampled mask.

    ``probability`` keeps values up to the threshold, ``land_binary`` zeros, any other
    kind what equals ``water`` (or differs, with ``invert``). ``auto`` takes a mask of
    zeros and ones as binary, its water being the commoner value, and one inside
    0 to 1 as a probability. If equality would keep nothing and all values lie inside 0
    to 1, the threshold decides. Points without a value go.
    """
    v, unit = F.col(column), (F.col("_low") >= -TINY) & (F.col("_high") <= 1 + TINY)
    binary = F.col("_n0") + F.col("_n1") == F.col("_n")
    auto = F.lit(kind == "auto")
    probable = F.lit(kind == "probability") | (auto & ~binary & unit)
    wanted = F.when(auto & binary, F.when(F.col("_n0") >= F.col("_n1"), 0.0).otherwise(1.0)).when(F.lit(kind == "land_binary"), 0.0).otherwise(F.lit(water))
    hits = F.when(auto & binary, F.greatest("_n0", "_n1")).when(F.lit(kind == "land_binary"), F.col("_n0")).otherwise(F.col("_nw"))
    flip = F.lit(invert and kind != "land_binary")
    none = F.when(flip, F.col("_n") - hits).otherwise(hits) == 0
    equal = F.abs(v - wanted) <= TINY
    keep = F.when(probable | (none & unit), v <= threshold).when(flip, ~equal).otherwise(equal)
    return points.crossJoin(F.broadcast(_profile(points, column, water))).where(finite(column) & keep).drop(*_PROFILE)


def environment_filtered(
    points: DataFrame, land: str = "land", clear: str = "clear_water", land_max: float = 0.5, least_clear: float | None = 0.5, nodata_is_water: bool = True, survey: str = "extra_xyz"
) -> DataFrame:
    """Training points on clear water; survey points pass both tests.

    A land column of zeros and ones keeps its commoner value, any other keeps values up to ``land_max``.
    """
    both = (F.col("_n0") + F.col("_n1") == F.col("_n")) & (F.col("_n0") > 0) & (F.col("_n1") > 0)
    common = F.when(F.col("_n0") >= F.col("_n1"), 0.0).otherwise(1.0)
    dry = finite(land) & F.when(both, F.abs(F.col(land) - common) <= TINY).otherwise(F.col(land) <= land_max)
    on_water = F.coalesce(dry, F.lit(False)) | (~finite(land) & F.lit(nodata_is_water))
    is_clear = F.lit(True) if least_clear is None else F.coalesce(finite(clear) & (F.col(clear) >= least_clear), F.lit(False))
    return points.crossJoin(F.broadcast(_profile(points, land, 0.0))).where((on_water & is_clear) | (F.col("source") == survey)).drop(*_PROFILE)


def brightness_capped(points: DataFrame, most_blue: float | None = None, most_bright: float | None = None) -> DataFrame:
    out = points
    if most_blue is not None:
        out = out.where(F.col("b02") <= most_blue)
    return out if most_bright is None else out.where((F.col("b02") + F.col("b03") + F.col("b04")) / 3 <= most_bright)


def coast_water(pixels: DataFrame, mask: str, water: int = 0, invert: bool = False, erode: int = 2) -> DataFrame:
    """Water cells of a coast mask on the same grid, less a rim of ``erode`` steps."""
    is_water = F.coalesce(F.rint(mask) == water, F.lit(False))
    return eroded(pixels.withColumn("water", ~is_water if invert else is_water), "water", erode)


def channel_cells(cells: DataFrame, mask: str, inside: int = 1, invert: bool = False, corridor: DataFrame | None = None) -> DataFrame:
    """Cells with ``in_channel``: where the mask is known and equals ``inside`` (or not), and inside a corridor's cells if there is one."""
    known = F.col(mask).isNotNull()
    there = known & ((F.col(mask) != inside) if invert else (F.col(mask) == inside))
    if corridor is None:
        return cells.withColumn("in_channel", F.coalesce(there, F.lit(False)))
    near = corridor.select(*CELL).distinct().withColumn("_near", F.lit(True))
    return cells.join(near, CELL, "left").withColumn("in_channel", F.coalesce(there & F.col("_near"), F.lit(False))).drop("_near")


def kept_where(cells: DataFrame, columns: list[str], keep: Column, fill: float | None = None) -> DataFrame:
    """Columns keep their values where ``keep`` is true; elsewhere they are ``fill``."""
    return cells.withColumns({c: F.when(keep, F.col(c)).otherwise(F.lit(fill)) for c in columns})


def footprint_colours(colours: DataFrame, predicted: DataFrame, bands: list[str], depth: str = "depth", fill: float = 0.0) -> DataFrame:
    """Colour composite that shows only cells with a finite prediction."""
    there = predicted.where(finite(depth)).select(*CELL).withColumn("_there", F.lit(True))
    return kept_where(colours.join(there, CELL, "left"), bands, F.col("_there"), fill).drop("_there")


def strict_water(cells: DataFrame, depth: str, mask: str) -> DataFrame:
    """Depths only where the coast mask is 0; anything else, unknown too, is land."""
    return kept_where(cells, [depth], F.coalesce(F.col(mask) == 0, F.lit(False)))


def clipped_patch(cells: DataFrame, patch: str, patch_mask: str, channel: str, inside: int = 1, invert: bool = False) -> DataFrame:
    """Patch and its mask inside the channel; outside, the patch is null and the mask 0."""
    c = channel_cells(cells, channel, inside, invert)
    return kept_where(kept_where(c, [patch], F.col("in_channel")), [patch_mask], F.col("in_channel"), 0).drop("in_channel")


def without_land(cells: DataFrame, depth: str, land: str) -> DataFrame:
    """Depths less those on land, zeros among them, and those that aren't finite."""
    return kept_where(cells, [depth], finite(depth) & (F.coalesce(F.col(land), F.lit(0)) != 1))


def guarded_measurements(measurements: DataFrame, sections: DataFrame, most_dist: float = 2000.0, window: float = 1.15, least_n: int = 6, least_sections: int = 3) -> DataFrame:
    """Width and stage rows that a site's fit may use: positive widths up to ``window`` times the median width of its near sections, enough of both."""
    top = sections.where(F.col("gage_dist_m") <= most_dist).groupBy("site_no").agg(F.count(F.lit(1)).alias("_k"), F.median("width_m").alias("top_width_m")).where((F.col("_k") >= least_sections) & (F.col("top_width_m") > 0))
    rows = measurements.join(top.drop("_k"), "site_no").where((F.col("width_m") > 0) & (F.col("width_m") <= window * F.col("top_width_m")))
    enough = rows.groupBy("site_no").agg(F.count(F.lit(1)).alias("n_used")).where(F.col("n_used") >= least_n)
    return rows.join(enough, "site_no")


def scene_validity(pixels: DataFrame, scl: str = "scl", grow: int = 1, name: str = "valid") -> DataFrame:
    """``pixels`` with ``name``: whether neither a cell nor, within ``grow`` steps along rows and columns, another is of a bad class; an unknown class isn't bad."""
    bad = pixels.withColumn(name, F.coalesce(~visible_class(F.col(scl)), F.lit(False)))
    bad = dilated(bad, name, grow) if grow > 0 else bad
    return bad.withColumn(name, ~F.col(name))

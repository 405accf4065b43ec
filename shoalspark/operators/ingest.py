"""Photon scans, scene rows, flowlines, areas and names: what comes before the first join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalspark.operators import ordered
from shoalspark.operators.points import TRACK, bottom_picks, photon_bins, surface_heights
from shoalspark.sources.files import in_box

Box = tuple[float, float, float, float]

# The side of the strong beam by orientation flag; names under which sources and bands come.
STRONG_SIDE = {0: "l", 1: "r", 21: "l"}
SOURCE_NAMES = {
    "atl24": ("atl24",), "atl03": ("atl03", "atl03_refraction", "atl03_ref"),
    "xyz": ("xyz", "extra_xyz", "sonar", "lidar", "bathy", "bathymetry", "soundings", "multibeam", "survey"),
}
BAND_NAMES = {"B02": ("B02", "B2", "BLUE"), "B03": ("B03", "B3", "GREEN"), "B04": ("B04", "B4", "RED"), "B08": ("B08", "B8", "NIR")}


def finite(*columns: str) -> Column:
    """Whether all columns hold finite numbers."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    return out


def photon_scan(raw: DataFrame, box: Box | None = None, least_conf: int | None = None) -> DataFrame:
    """Photons (granule, laser, orient, latitude, longitude, photon_height, conf) with their beam; finite ones, inside a box, from a confidence on.

    All conditions are on plain columns, so that Parquet row groups are skipped.
    """
    side = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in STRONG_SIDE.items() for x in pair)), F.col("orient")), F.lit("l"))
    kept = raw.where(finite("latitude", "longitude", "photon_height", "conf"))
    if box:
        kept = kept.where(in_box(F.col("longitude"), F.col("latitude"), box))
    if least_conf is not None:
        kept = kept.where(F.col("conf") >= least_conf)
    return kept.withColumn("beam", F.concat(F.lit("gt"), F.col("laser").cast("string"), side))


def classified_scan(raw: DataFrame, least_conf: float = 0.0, bottom_class: int = 40) -> DataFrame:
    """Bottom photons (lat_ph, lon_ph, ortho_h, surface_h, class_ph, confidence, delta_time) with a depth that is negative downwards."""
    kept = raw.where((F.col("class_ph") == bottom_class) & (F.col("confidence") >= least_conf)).where(finite("lat_ph", "lon_ph", "ortho_h", "surface_h"))
    return kept.withColumn("depth_m", -F.abs(F.col("surface_h") - F.col("ortho_h")))


def classified_product(photons: DataFrame, lat_res: float, height_res: float) -> DataFrame:
    """Bottom picks of raw photons in the layout of classified ones, one row a track and latitude bin."""
    binned = photon_bins(photons, lat_res, height_res)
    surface = surface_heights(binned, height_res=height_res)
    place = binned.groupBy(*TRACK, "lat_bin").agg(F.avg("latitude").alias("lat_ph"), F.avg("longitude").alias("lon_ph"), F.avg("delta_time").alias("delta_time"))
    picks = bottom_picks(binned, surface, height_res).join(surface.select(*TRACK, "lat_bin", "surface_m"), [*TRACK, "lat_bin"]).join(place, [*TRACK, "lat_bin"])
    return picks.select(*TRACK, "lat_ph", "lon_ph", F.col("bottom_m").alias("ortho_h"), F.col("surface_m").alias("surface_h"), F.lit(40).alias("class_ph"), F.col("frac_bottom").alias("confidence"), "delta_time")


def quality_picks(picks: DataFrame, least_depth: float = 0.5, most_depth: float = 40.0, least_bottom: int = 3, least_share: float = 0.1) -> DataFrame:
    """Picks inside the depth range with enough bottom photons, by number and by share."""
    return picks.where(F.col("depth_m").between(-most_depth, -least_depth) & (F.col("n_bottom") >= least_bottom) & (F.col("frac_bottom") >= least_share))


def track_lines(photons: DataFrame, box: Box, every: int = 100) -> DataFrame:
    """Line of each track through every ``every``-th photon that lies in the box, with two at least."""
    rows = ordered.placed(photons, TRACK, ["delta_time", "photon_height", "conf"]).withColumn("_n", F.col(ordered.PLACE))
    some = ordered.plain(rows).where((F.col("_n") % every == 0) & in_box(F.col("longitude"), F.col("latitude"), box))
    lines = some.groupBy(*TRACK).agg(F.array_sort(F.collect_list(F.struct("_n", "longitude", "latitude"))).alias("_p")).where(F.size("_p") > 1)
    return lines.select(*TRACK, F.transform("_p", lambda p: F.struct(p["longitude"].alias("x"), p["latitude"].alias("y"))).alias("coords"))


def scene_rows(items: DataFrame, most_cloud: float) -> DataFrame:
    """Catalog items with the first ``reason`` for which they are dropped; null: the scene is kept."""
    reason = (
        F.when(F.col("dt").isNull(), "no_datetime").when(F.col("cloud") > most_cloud, "cloudy").when(F.col("geometry").isNull(), "no_geometry").when(F.coalesce(F.col("tile"), F.lit("UNK")) == "UNK", "no_tile")
    )
    return items.withColumn("reason", reason)


def drop_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def parsed_area(text: Column, buffer: float = 0.0) -> dict[str, Column]:
    """West, east, south and north of a text ``W/E/S/N``, widened by a share of the box; null where it has not four numbers."""
    parts = F.split(text, "/")
    w, e, s, n = (F.when(F.size(parts) == 4, F.try_element_at(parts, F.lit(i)).try_cast("double")) for i in range(1, 5))
    return {"west": w - (e - w) * buffer, "east": e + (e - w) * buffer, "south": s - (n - s) * buffer, "north": n + (n - s) * buffer}


def target_grid(extent: DataFrame, resolution: float) -> DataFrame:
    """One-row ``grids`` table of an extent (x0, x1, y0, y1): whole cells of about the resolution, origin at the upper left."""
    cells = lambda lo, hi: F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo)) / resolution)).cast("int")
    g = extent.select(F.col("x0").alias("origin_x"), F.col("y1").alias("origin_y"), cells("x0", "x1").alias("columns"), cells("y0", "y1").alias("rows"), "x0", "x1", "y0", "y1")
    return g.select("origin_x", "origin_y", "columns", "rows", ((F.col("x1") - F.col("x0")) / F.col("columns")).alias("cell_w"), ((F.col("y1") - F.col("y0")) / F.col("rows")).alias("cell_h"))


def line_segments(lines: DataFrame) -> DataFrame:
    """``(river_id, seq, ax, ay, bx, by)`` of lines (river_id, coords array of x, y) without segments of no length."""
    two = F.posexplode(F.expr("transform(sequence(2, size(coords)), i -> struct(coords[i-2].x as ax, coords[i-2].y as ay, coords[i-1].x as bx, coords[i-1].y as by))"))
    s = lines.where(F.size("coords") > 1).select("river_id", two.alias("seq", "s")).select("river_id", "seq", "s.*")
    return s.where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))


def clipped_segments(segments: DataFrame, box: Box) -> DataFrame:
    """Parts of segments inside a box, by the shares of their length at which they enter and leave it; none of no length."""
    west, east, south, north = box

    def span(a: str, b: str, low: float, high: float) -> tuple[Column, Column]:
        d = F.col(b) - F.col(a)
        outside = (F.col(a) < low) | (F.col(a) > high)
        first, second = F.try_divide(low - F.col(a), d), F.try_divide(high - F.col(a), d)
        return F.when(d == 0, F.when(outside, 2.0).otherwise(0.0)).otherwise(F.least(first, second)), F.when(d == 0, 1.0).otherwise(F.greatest(first, second))

    (x_in, x_out), (y_in, y_out) = span("ax", "bx", west, east), span("ay", "by", south, north)
    s = segments.withColumns({"_t0": F.greatest(F.lit(0.0), x_in, y_in), "_t1": F.least(F.lit(1.0), x_out, y_out)}).where(F.col("_t0") < F.col("_t1"))
    at = lambda a, b, t: (F.col(a) + F.col(t) * (F.col(b) - F.col(a)))
    return s.select("river_id", "seq", at("ax", "bx", "_t0").alias("ax"), at("ay", "by", "_t0").alias("ay"), at("ax", "bx", "_t1").alias("bx"), at("ay", "by", "_t1").alias("by"))


def clipped_lines(lines: DataFrame, box: Box) -> DataFrame:
    """``(river_id, length_m, pieces, parts)`` of what lies inside the box; pieces that don't join are parts of their own."""
    s = clipped_segments(line_segments(lines), box)
    w = Window.partitionBy("river_id").orderBy("seq")
    joined = (F.lag("bx").over(w) == F.col("ax")) & (F.lag("by").over(w) == F.col("ay"))
    s = s.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("long"))
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return s.groupBy("river_id").agg(F.sum(length).alias("length_m"), F.count(F.lit(1)).alias("pieces"), F.sum("_new").alias("parts"))


def ingested_flowlines(raw: DataFrame, box: Box, id_columns: list[str]) -> DataFrame:
    """Lines that meet the box, whole, with the first id that is there (else ``reach_`` and the row's number) and their length."""
    made = F.concat(F.lit("reach_"), F.col("row").cast("string"))
    named = raw.withColumn("river_id", F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in id_columns), made))
    keyed = named.select(F.col("row").alias("river_id"), "coords")
    s = line_segments(keyed)
    meets = clipped_segments(s, box).select("river_id").distinct()
    length = s.groupBy("river_id").agg(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("length_m"))
    return named.join(length.join(meets, "river_id", "left_semi").withColumnRenamed("river_id", "row"), "row")


def centrelines(rivers: DataFrame, types: tuple[int, ...] = (460,), artificial: bool = False, least_order: int = 3, least_km: float = 0.05) -> DataFrame:
    """Rivers of the feature types (558 with ``artificial``) that are of an order and length at least; missing values fail."""
    allowed = {*types, 558} if artificial else set(types)
    return rivers.where(F.col("ftype").isin(*sorted(allowed)) & (F.coalesce("stream_order", F.lit(-1)) >= least_order) & (F.coalesce("length_km", F.lit(0.0)) >= least_km))


def _by_name(names: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*(F.lit(x) for canon, aliases in names.items() for alias in aliases for x in (alias, canon)))


def source_name(value: Column) -> Column:
    """Common name of a source, or ``unknown``."""
    return F.coalesce(F.try_element_at(_by_name(SOURCE_NAMES), F.lower(F.trim(value))), F.lit("unknown"))


def stacked_tie_points(points: DataFrame, order: tuple[str, ...] = ("xyz", "atl03", "atl24")) -> DataFrame:
    """Tie points of the sources in ``order``, with their place in it; sort by ``stack`` to stack them."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("tie_source")) - 1
    return points.withColumn("tie_source", source_name(F.col("source"))).withColumn("stack", place.cast("int")).where(F.col("stack") >= 0)


def band_map(values: Column) -> Column:
    """Map with the bands' standard keys, 0 where none is given; of several names for a band the greatest value counts."""
    known = F.transform(F.map_entries(values), lambda e: F.struct(F.try_element_at(_by_name(BAND_NAMES), F.upper(F.trim(e["key"]))).alias("k"), e["value"].cast("double").alias("v")))
    of = lambda band: F.coalesce(F.array_max(F.transform(F.filter(known, lambda x: x["k"] == band), lambda x: x["v"])), F.lit(0.0))
    return F.create_map(*(x for band in BAND_NAMES for x in (F.lit(band), of(band))))


def first_of(values: Column, keys: tuple[str, ...], default: float) -> Column:
    """Value of the first key that the map has."""
    return F.coalesce(*(F.try_element_at(values, F.lit(k)) for k in keys), F.lit(default))


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the first in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def ordered_sections(sections: DataFrame, group: str = "component_id", station: str = "s_center_m", key: str = "xs_id") -> DataFrame:
    """Sections hashed by group and sorted inside each partition, as along-river windows want them, with their place in the group."""
    w = Window.partitionBy(group).orderBy(station, key)
    return sections.repartition(group).sortWithinPartitions(group, station, key).withColumn("place", F.row_number().over(w))

"""Links of points, sections and stations: gages on reaches, sections to gages, tide stations, boxes that widen when nothing is in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.operators.channels import chainage
from shoalspark.operators.joins import knn
from shoalspark.operators.surveys import nearest_prediction
from shoalspark.session import checkpointed


def snapped_to_reaches(points: DataFrame, reaches: DataFrame, key: str, most: float, name: str = "river_id") -> DataFrame:
    """``points`` with the ``name`` of the reach (line_id, seq, x, y) whose course is nearest, within ``most``, and ``snap_m``; null beyond."""
    return chainage(points, reaches, key, most).withColumnsRenamed({"line_id": name, "off_m": "snap_m"}).drop("s_m")


def gage_links(sections: DataFrame, gages: DataFrame, radius: float, key: str = "xs_id", river: str = "river_id") -> DataFrame:
    """``sections`` (x, y, river) with ``gage_site`` and ``gage_m``: the nearest gage (site_no, sx, sy, river) of their own river.

    Where the river has no gage, or isn't known, all gages count. A section that has a link already (columns ``gage_site`` and
    ``gage_m``) keeps it unless the new gage is nearer; a link without a name or a finite distance is replaced. Of gages as far the
    lesser site wins. Sections without a place keep what they have. ``radius`` only starts the search.
    """
    keyed = gages.select(F.col("site_no").alias("_site"), F.col("sx").alias("rx"), F.col("sy").alias("ry"), F.col(river).alias("_river"))
    asked = checkpointed(sections.select(F.col(key).alias("_xs"), "x", "y", F.col(river).alias("_river")).where(F.col("x").isNotNull() & F.col("y").isNotNull()))
    gaged = keyed.where(F.col("_river").isNotNull()).select("_river").distinct()
    own = knn(asked.join(gaged, "_river", "left_semi"), keyed.where(F.col("_river").isNotNull()), 1, radius, "_xs", "_site", by=("_river",))
    other = knn(asked.join(gaged, "_river", "left_anti").drop("_river"), keyed.drop("_river"), 1, radius, "_xs", "_site")
    found = own.select("_xs", "_site", "dist").unionByName(other.select("_xs", "_site", "dist")).withColumnRenamed("dist", "_dist")
    had = {"gage_site": "string", "gage_m": "double"}
    before = sections.withColumns({c: F.lit(None).cast(t) for c, t in had.items() if c not in sections.columns})
    lost = F.col("gage_site").isNull() | F.lower(F.trim("gage_site")).isin("", "nan", "none") | F.col("gage_m").isNull() | F.isnan("gage_m") | (F.abs("gage_m") == float("inf"))
    new = F.col("_site").isNotNull() & (lost | (F.col("_dist") < F.col("gage_m")))
    out = before.join(found, F.col(key) == F.col("_xs"), "left").drop("_xs").withColumn("_new", new)
    picked = {"gage_site": F.when(F.col("_new"), F.col("_site").cast("string")).otherwise(F.col("gage_site")), "gage_m": F.when(F.col("_new"), F.col("_dist")).otherwise(F.col("gage_m"))}
    return out.withColumns(picked).drop("_site", "_dist", "_new")


def tide_at(requests: DataFrame, stations: DataFrame, predictions: DataFrame, key: str, most: float = 3.0, box: tuple[float, float, float, float] = (-130.0, -60.0, 24.0, 50.0)) -> DataFrame:
    """``requests`` (longitude, latitude, at) with ``sid``, ``dist``, and the station's prediction (sid, at, tide) nearest in time.

    Stations (sid, sx, sy) count when nearer than ``most`` degrees, requests when inside ``box`` (west, east, south, north) and not on its edge; the
    lesser station, and the earlier prediction, of equals. Requests without a station have nulls.
    """
    west, east, south, north = box
    inside = (F.col("longitude") > west) & (F.col("longitude") < east) & (F.col("latitude") > south) & (F.col("latitude") < north)
    left = checkpointed(requests.where(inside).select(F.col(key).alias("_k"), F.col("longitude").alias("x"), F.col("latitude").alias("y")))
    right = stations.select("sid", F.col("sx").alias("rx"), F.col("sy").alias("ry"))
    near = knn(left, right, 1, most, "_k", "sid").where(F.col("dist") < most).select("_k", "sid", "dist")
    linked = requests.join(near, F.col(key) == F.col("_k"), "left").drop("_k")
    return nearest_prediction(linked, predictions, ["sid"], "at", "tide")


def in_area(points: DataFrame, box: tuple[float, float, float, float], relax: float = 0.0, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Points in a box (west, east, south, north); if it holds none, those in the box widened by ``relax`` of its sides on each of them.

    Whether the box holds any is one aggregate, joined as one row, so that both come from one plan.
    """
    west, east, south, north = box
    dx, dy = (east - west) * relax, (north - south) * relax
    strict = F.col(x).between(west, east) & F.col(y).between(south, north)
    if relax <= 0:
        return points.where(strict)
    wide = points.where(F.col(x).between(west - dx, east + dx) & F.col(y).between(south - dy, north + dy))
    any_strict = wide.agg(F.coalesce(F.bool_or(strict), F.lit(False)).alias("_any"))  # one row
    return wide.crossJoin(F.broadcast(any_strict)).where(~F.col("_any") | strict).drop("_any")


def ranked_dates(scenes: DataFrame, weights: Column, months: tuple[int, ...] = (), every_tile: bool = False, n: int = 10, date: str = "date") -> DataFrame:
    """The ``n`` dates of least cloud weighted by tile: ``score`` (100 without weight) and ``tiles``; preferred months only, if any are given.

    Each tile counts with its best scene (tile, cloud) of a date. With ``every_tile`` only dates that all tiles have are ranked. Equal scores go by date.
    """
    kept = scenes.where(F.month(date).isin(*months)) if months else scenes
    best = kept.groupBy(date, "tile").agg(F.min("cloud").alias("cloud")).withColumn("_w", F.coalesce(weights, F.lit(0.0)))
    dates = best.groupBy(date).agg(F.coalesce(F.try_divide(F.sum(F.col("cloud") * F.col("_w")), F.sum("_w")), F.lit(100.0)).alias("score"), F.count(F.lit(1)).alias("tiles"))
    if every_tile:
        dates = dates.crossJoin(F.broadcast(scenes.agg(F.count_distinct("tile").alias("_all")))).where(F.col("tiles") == F.col("_all")).drop("_all")  # one row
    return dates.orderBy(F.round("score", 6), date).limit(n)

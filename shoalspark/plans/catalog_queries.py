"""Queries of scene catalogs: items in several conventions are written as JSON from the scenes and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.plans.registry import query
from shoalspark.session import shared_path
from shoalspark.sources import files

C = F.col
_BANDS = ("B02", "B03", "B04", "B08", "SCL")


def _when(kind: int, value):
    return F.when(C("scene_id") % 4 == kind, value)


def _items(s: DataFrame) -> str:
    """Four conventions by scene: keys of one archive, of another, text only, and nearly nothing but the id."""
    tile = F.concat(F.lit("1"), F.substring("tile", 2, 1), F.lit("RDU"))
    day = F.concat(F.lit("2021-03-"), F.lpad((C("day_no") + 1).cast("string"), 2, "0"), F.lit("T16:00:00Z"))
    link = lambda name, ending: F.concat(F.lit("https://host/"), C("scene_id").cast("string"), F.lit(f"/{name}{ending}"))
    asset = lambda href, media=None: F.struct(href.alias("href"), F.lit(media).cast("string").alias("type"))
    none = F.lit(None).cast("string")
    props = F.struct(
        F.when(C("scene_id") % 4 < 2, day).alias("datetime"), _when(2, day).alias("start_datetime"), F.when(C("scene_id") % 4 < 3, C("cloud")).alias("eo:cloud_cover"),
        _when(0, F.concat(F.lit("T"), tile)).alias("s2:mgrs_tile"), _when(1, F.concat(F.lit("MGRS-"), tile)).alias("grid:code"), _when(2, F.concat(F.lit("tile of the grid: "), tile)).alias("title"),
        _when(0, C("scene_id") % 143).alias("sat:relative_orbit"), _when(2, (C("scene_id") % 143).cast("string")).alias("relative_orbit"),
        _when(0, C("sun_zenith")).alias("s2:mean_solar_zenith"), _when(1, 90 - C("sun_zenith")).alias("view:sun_elevation"), _when(2, C("sun_zenith").cast("string")).alias("solar_zenith_angle"),
        _when(0, C("sun_zenith") * 3).alias("view:sun_azimuth"), _when(1, C("scene_id") % 12 * 1.0).alias("view:off_nadir"), _when(2, F.lit("unknown")).alias("view_zenith"), _when(1, C("scene_id") % 360 * 1.0).alias("view_azimuth"),
    )
    name = F.when(C("scene_id") % 4 == 3, F.concat(F.lit("S2A_R"), F.lpad((C("scene_id") % 143).cast("string"), 3, "0"), F.lit("_T"), tile, F.lit("_x"))).otherwise(F.concat(F.lit("scene-"), C("scene_id").cast("string")))
    named = F.create_map(F.lit("blue"), asset(link("B02", ".tif?sig=1")), F.lit("green"), asset(link("g", ""), "image/jp2"), F.lit("nir"), asset(none), F.lit("B08"), asset(link("n", ".dat")))
    fine = F.create_map(F.lit("B02"), asset(link("B02_60m", ".jp2")), F.lit("B02_10m"), asset(link("a", ".jp2")), F.lit("red"), asset(F.lit("s3://bucket/B04.tif")), F.lit("SCL_20m"), asset(link("scl", ".tiff")))
    odd = F.create_map(F.lit("visual"), asset(link("all", ".tif")), F.lit("x_b03"), asset(link("x", ".jp2"), "image/tiff; application=geotiff"), F.lit("y"), asset(link("B03_10m", ".jp2")))
    assets = F.when(C("scene_id") % 4 == 0, named).when(C("scene_id") % 4 == 1, fine).when(C("scene_id") % 4 == 2, odd)
    path = shared_path(s.sparkSession, "items")
    s.select(name.alias("id"), props.alias("properties"), assets.alias("assets")).write.json(path)
    return path


_ID = "CASE WHEN k = 3 THEN concat('S2A_R', lpad(CAST(scene_id % 143 AS VARCHAR), 3, '0'), '_T1', substr(tile, 2, 1), 'RDU_x') ELSE concat('scene-', scene_id) END"


@query(
    "s9_scene_catalog", "fx_scenes", doubles="cloud sun_zenith sun_azimuth view_zenith view_azimuth",
    twin=f"""SELECT {_ID} AS id, CASE WHEN k < 3 THEN concat('2021-03-', lpad(CAST(day_no + 1 AS VARCHAR), 2, '0'), ' 16:00:00') END AS at, CASE WHEN k < 3 THEN cloud ELSE 1e2 END AS cloud, concat('1', substr(tile, 2, 1), 'RDU') AS tile,
        CASE WHEN k = 1 THEN 'UNK' ELSE lpad(CAST(scene_id % 143 AS VARCHAR), 3, '0') END AS orbit, CASE WHEN k < 3 THEN CAST(sun_zenith AS DOUBLE) END AS sun_zenith, CASE WHEN k = 0 THEN CAST(sun_zenith * 3 AS DOUBLE) END AS sun_azimuth,
        CASE WHEN k = 1 THEN scene_id % 12 * 1e0 END AS view_zenith, CASE WHEN k = 1 THEN scene_id % 360 * 1e0 END AS view_azimuth FROM (SELECT *, scene_id % 4 AS k FROM fx_scenes)""",
)
def _(s):
    return files.scene_catalog(s.sparkSession, _items(s)).withColumn("dt", F.date_format("dt", "yyyy-MM-dd HH:mm:ss")).withColumnRenamed("dt", "at").drop("assets")


@query(
    "s11_band_assets", "fx_scenes",
    twin=f"""SELECT {_ID} AS id, band, concat('https://host/', scene_id, l) AS href, suffix FROM (SELECT *, scene_id % 4 AS k FROM fx_scenes) JOIN (VALUES (0, 'B02', '/B02.tif?sig=1', '.tif'), (0, 'B03', '/g', '.jp2'), (0, 'B08', '/n.dat', '.dat'),
        (1, 'B02', '/a.jp2', '.jp2'), (1, 'SCL', '/scl.tiff', '.tif'), (2, 'B03', '/B03_10m.jp2', '.jp2')) AS t(k, band, l, suffix) USING (k)""",
)
def _(s):
    scenes = files.scene_catalog(s.sparkSession, _items(s))
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), files.band_asset(C("assets"), b).alias("asset")) for b in _BANDS)))
    return scenes.select("id", each.alias("e")).where(C("e.asset").isNotNull()).select("id", "e.band", "e.asset.*")

"""Survey points, soundings, gage tables, scene catalogs; grids, points and training sets as sinks."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names under which columns come.
ALIASES = {
    "x": ("x", "lon", "longitude", "long", "easting"), "y": ("y", "lat", "latitude", "northing"), "z": ("z", "depth", "depth_m", "elev", "elevation", "z_m"),
    "uncertainty": ("uncertainty", "unc", "sigma", "tvu"), "width_m": ("width_m", "width_ft", "width"), "stage_m": ("stage_m", "stage_ft", "gage_height", "stage"), "site_no": ("site_no", "site", "gage"),
}


def resolve(columns: list[str], role: str) -> str | None:
    """Column of a role: an exact alias first, then one that is part of the name."""
    lower = {c.lower(): c for c in columns}
    return next((lower[a] for a in ALIASES[role] if a in lower), None) or next((lower[c] for a in ALIASES[role] if len(a) > 1 for c in lower if a in c), None)


def by_header(spark: SparkSession, paths: list[str] | str, **options: str) -> list[DataFrame]:
    """One frame of strings, with ``file``, for each header that the CSV files have; columns go by name, as files differ in their order.

    The first lines are found by a scan and grouped, so that the driver sees file names by header.
    """
    lookup = {k: v for k, v in options.items() if k in ("recursiveFileLookup", "pathGlobFilter")}
    lines = spark.read.options(**lookup).text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")).where("at = 0")
    first = lines.withColumn("place", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "place").alias("header"))
    plain = {k: v for k, v in options.items() if k not in lookup}
    found = []
    for r in first.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("header").collect():
        names = [re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(f)) for f in r["files"]]
        found.append(spark.read.options(**plain).csv(names, header=True).withColumn("file", F.col("_metadata.file_path")))
    return found


def _numbers(tables: list[DataFrame], roles: dict[str, str], spark: SparkSession, optional: tuple[str, ...] = ()) -> DataFrame:
    """Rows of all tables with each role's column as a double under its name, and ``file``; a table without a needed role is an error, without an optional one null."""
    out = spark.createDataFrame([], ", ".join([f"`{n}` double" for n in roles.values()] + ["file string"]))
    for t in tables:
        columns = {n: resolve([c for c in t.columns if c != "file"], role) for role, n in roles.items()}
        missing = [n for n, c in columns.items() if c is None and n not in optional]
        if missing:
            raise ValueError(f"no column for {', '.join(missing)} in {t.columns}")
        out = out.unionByName(t.select(*((F.col(f"`{c}`").try_cast("double") if c else F.lit(None).cast("double")).alias(n) for n, c in columns.items()), "file"))
    return out


def survey_points(spark: SparkSession, paths: list[str], box: tuple[float, float, float, float] | None = None, sep: str = ",") -> DataFrame:
    """Points of many files: aliases, sign by file (flipped if nine tenths are positive), outliers beyond 5 MAD dropped, clipped."""
    p = _numbers(by_header(spark, paths, sep=sep), {"x": "longitude", "y": "latitude", "z": "z"}, spark).dropna()
    stats = p.groupBy("file").agg(F.avg((F.col("z") > 0).cast("double")).alias("positive"), F.median("z").alias("med"))
    p = p.join(stats, "file")
    mad = p.groupBy("file").agg(F.median(F.abs(F.col("z") - F.col("med"))).alias("mad"))
    p = p.join(mad, "file").where((F.col("mad") == 0) | (F.abs(F.col("z") - F.col("med")) <= 5 * 1.4826 * F.col("mad")))
    out = p.select("longitude", "latitude", F.when(F.col("positive") >= 0.9, -F.col("z")).otherwise(F.col("z")).alias("depth_m"), F.lit("extra_xyz").alias("source"), "file")
    return out if box is None else out.where(in_box(F.col("longitude"), F.col("latitude"), box))


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    west, east, south, north = box
    return x.between(west, east) & y.between(south, north)


def soundings(spark: SparkSession, path: str) -> DataFrame:
    """Soundings below a folder, each file once, with depth or elevation, and the file they came from."""
    tables = by_header(spark, path, recursiveFileLookup="true", pathGlobFilter="*.csv")
    return _numbers(tables, {"x": "x", "y": "y", "z": "depth_m"}, spark).dropna().dropDuplicates(["x", "y", "depth_m"])


def high_quality_points(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Points x, y, z by alias with an ``uncertainty``, null where the file has no such column; rows without a finite place and value go."""
    p = _numbers(by_header(spark, paths), {"x": "x", "y": "y", "z": "z", "uncertainty": "uncertainty"}, spark, ("uncertainty",)).drop("file")
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return p.where(ok)


def tie_points(spark: SparkSession, path: str, layers: tuple[str, ...] = ("all",), positive_down: bool = True) -> DataFrame:
    """Tie points of the wanted ``split`` layers of a written training set, of ``all`` where none of them is there; depths negative-down."""
    stored = spark.read.parquet(path)
    wanted = stored.where(F.col("split").isin(*layers))
    rows = stored.where(F.col("split") == "all") if wanted.isEmpty() else wanted
    return rows.withColumn("depth_m", -F.abs("depth_m")) if positive_down else rows


def width_stage(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Width and stage pairs, feet to metres where the column's name says so."""
    metres = lambda c: F.col(f"`{c}`").try_cast("double") * (0.3048 if c.lower().endswith("ft") else 1.0)
    out = spark.createDataFrame([], "site_no string, width_m double, stage_m double")
    for raw in by_header(spark, paths):
        cols = {r: resolve([c for c in raw.columns if c != "file"], r) for r in ("site_no", "width_m", "stage_m")}
        out = out.unionByName(raw.select(F.col(f"`{cols['site_no']}`").alias("site_no"), metres(cols["width_m"]).alias("width_m"), metres(cols["stage_m"]).alias("stage_m")))
    return out.dropna()


def gage_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated table with ``#`` comments whose first row holds types."""
    raw = spark.read.csv(path, header=True, sep="\t", comment="#")
    return raw.where(~F.col(f"`{raw.columns[0]}`").rlike(r"^\d+[sdn]$"))


# Keys under which a scene's properties come, the preferred first.
SCENE_KEYS = {
    "datetime": ("datetime", "start_datetime", "end_datetime", "created"),
    "tile": ("s2:mgrs_tile", "mgrs:tile", "sentinel:mgrs_tile", "s2:tile", "tileid", "tileId", "mgrs_tile", "mgrsTile", "s2:tile_id", "s2:tileid", "earthsearch:mgrid", "grid:code"),
    "orbit": ("sat:relative_orbit", "s2:relative_orbit", "relative_orbit"),
    "sun_zenith": ("s2:mean_solar_zenith", "view:sun_zenith", "sun_zenith", "mean_solar_zenith", "solar_zenith_angle"),
    "sun_elevation": ("view:sun_elevation", "sun_elevation", "s2:sun_elevation"),
    "sun_azimuth": ("s2:mean_solar_azimuth", "view:sun_azimuth", "sun_azimuth", "mean_solar_azimuth", "solar_azimuth_angle"),
    "view_zenith": ("s2:mean_viewing_zenith", "view:off_nadir", "view_zenith", "mean_viewing_zenith", "viewing_zenith_angle", "s2:viewing_zenith"),
    "view_azimuth": ("s2:mean_viewing_azimuth", "view:azimuth", "view_azimuth", "mean_viewing_azimuth", "viewing_azimuth_angle", "s2:viewing_azimuth"),
}
# Keys of a band's asset, the preferred first.
ASSET_KEYS = {
    "B02": ("B02", "B02_10m", "blue", "BLUE"), "B03": ("B03", "B03_10m", "green", "GREEN"), "B04": ("B04", "B04_10m", "red", "RED"),
    "B08": ("B08", "B08_10m", "nir", "NIR"), "SCL": ("SCL", "SCL_20m", "scl", "SCL_20M"),
}
_TILE = r"(\d{2}[A-Z]{3})"


def scene_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Scenes of JSON items, whatever of the known keys their properties use and whether values are numbers or text.

    ``tile`` comes from a key, else from a value that is a tile or speaks of one, else from the id, else it is ``UNK``; ``orbit`` is the
    relative orbit in three digits, by key or id, else ``UNK``; ``cloud`` is 100 where it is missing. Angles and times that aren't there
    or can't be read are null; a sun elevation stands in for a missing zenith.
    """
    raw = spark.read.schema("id string, properties map<string, string>, assets map<string, struct<href: string, type: string>>").json(path)
    text = lambda k: F.try_element_at("properties", F.lit(k))
    first = lambda role, made: F.coalesce(*(made(text(k)) for k in SCENE_KEYS[role]))
    number = lambda c: c.try_cast("double")
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    found = lambda c, pattern: F.nullif(F.regexp_extract(F.upper(c), pattern, 1), F.lit(""))
    sun = F.coalesce(first("sun_zenith", number), 90 - first("sun_elevation", number))
    says = F.filter(F.map_values("properties"), lambda v: F.upper(F.trim(v)).rlike(rf"^{_TILE}$") | (F.upper(v).rlike(_TILE) & F.upper(v).rlike("MGRS|TILE|GRID")))
    by_id = [found(F.col("id"), p) for p in (rf"_T{_TILE}_", rf"\bT{_TILE}\b", rf"\b{_TILE}\b")]
    tile = F.coalesce(first("tile", lambda c: found(c, _TILE)), found(F.get(says, 0), _TILE), *by_id, F.lit("UNK"))
    by_key = first("orbit", lambda c: number(c).cast("int"))
    orbit = F.coalesce(F.when(by_key.isNotNull(), F.format_string("%03d", by_key)), F.nullif(F.regexp_extract("id", r"_R(\d{3})_", 1), F.lit("")), F.lit("UNK"))
    return raw.select(
        "id", F.try_to_timestamp(first("datetime", given)).alias("dt"), F.coalesce(number(text("eo:cloud_cover")), F.lit(100.0)).alias("cloud"), tile.alias("tile"), orbit.alias("orbit"),
        sun.alias("sun_zenith"), *(first(a, number).alias(a) for a in ("sun_azimuth", "view_zenith", "view_azimuth")), "assets",
    )


def band_asset(assets: Column, band: str) -> Column:
    """Struct (href, suffix) of the best web link to a band among a scene's assets; null where there is none.

    The band's own keys come before any key or link that names the band; of either kind those with 10 m in key or link come first, then the
    preferred key or the earlier asset. The suffix follows the media type and, without a telling one, the link.
    """
    own = F.array(*map(F.lit, ASSET_KEYS.get(band.upper(), (band.upper(), band.lower()))))
    name = F.lit(band.upper())

    def ranked(e: Column, i: Column) -> Column:
        key, href = e["key"], e["value"]["href"]
        web = F.lower(href).rlike("^https?://")
        fine = F.lower(key).contains("10m") | F.lower(href).contains("10m")
        place = F.array_position(own, key)
        score = F.when(place > 0, 10 + F.when(fine, 2).otherwise(0)).when(F.upper(key).contains(name) | F.upper(href).contains(name), 1 + F.when(fine, 5).otherwise(0))
        media, link = F.lower(F.coalesce(e["value"]["type"], F.lit(""))), F.lower(href)
        suffix = F.when(media.contains("jp2") | link.rlike(r"\.jp2(\?|$)"), ".jp2").when(media.rlike("tiff|cog") | link.rlike(r"\.tif(f$|\?|$)"), ".tif").otherwise(".dat")
        return F.when(web & score.isNotNull(), F.struct((-score).alias("less"), F.when(place > 0, place).otherwise(i).alias("place"), href.alias("href"), suffix.alias("suffix")))

    best = F.array_min(F.array_compact(F.transform(F.map_entries(assets), ranked)))
    return F.when(best.isNotNull(), F.struct(best["href"].alias("href"), best["suffix"].alias("suffix")))


def band_href(assets: Column, names: list[str]) -> Column:
    """Link of the first of the asset names that is there."""
    return F.coalesce(*(F.try_element_at(assets, F.lit(n))["href"] for n in names))


def date_windows(df: DataFrame, start: str, end: str, months: int) -> DataFrame:
    """Windows of ``months`` from a start to an end date, the last cut at the end."""
    begin = F.explode(F.sequence(F.col(start), F.col(end), F.make_interval(F.lit(0), F.lit(months))))
    w = df.withColumn("window_start", begin)
    return w.withColumn("window_end", F.least(F.col(end), F.date_sub(F.add_months("window_start", months), 1)))


def optional_csv(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A CSV file with a header, or no rows of the same schema where there is none."""
    if path:
        try:
            return spark.read.schema(schema).csv(path, header=True)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def write_grid(pixels: DataFrame, path: str, tile: int = 512, **tags: str) -> None:
    """Pixel table by tile, with units and sign as column metadata."""
    t = pixels.withColumns({"tile_r": F.floor(F.col("prow") / tile).cast("int"), "tile_c": F.floor(F.col("pcol") / tile).cast("int")})
    for column in ("depth", "sigma"):
        if column in t.columns and tags:
            t = t.withMetadata(column, tags)
    t.repartition("tile_r", "tile_c").write.mode("overwrite").partitionBy("tile_r", "tile_c").parquet(path)


def write_xyz(points: DataFrame, path: str, scale: float = 1.0) -> None:
    """x y z weight sigma, the weight from sigma."""
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.01), scale / F.greatest("sigma", F.lit(0.1))))
    points.select(*(F.format_string("%.6f", F.col(c)) for c in ("x", "y", "depth_m")), F.format_string("%.4f", weight), F.format_string("%.4f", F.col("sigma"))).write.mode("overwrite").csv(path, sep=" ")


def write_training(df: DataFrame, path: str) -> None:
    """Training rows in layers: all, train and test."""
    layers = df.withColumn("split", F.explode(F.array(F.lit("all"), F.when(F.col("is_test"), "test").otherwise("train"))))
    layers.write.mode("overwrite").partitionBy("split").parquet(path)

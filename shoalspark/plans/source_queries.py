"""Queries of readers and sinks: rows derived from the tables go to files in the shared folder and come back through the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.operators import modelling
from shoalspark.plans.registry import query
from shoalspark.session import shared_path
from shoalspark.sources import files

C = F.col


def _written(df: DataFrame, label: str, fmt: str = "csv", **options: str) -> str:
    path = shared_path(df.sparkSession, label)
    df.write.options(**options).format(fmt).save(path)
    return path


@query("s3_survey_points", "fx_points", doubles="longitude latitude depth_m", twin="SELECT longitude, latitude, depth_m, 'extra_xyz' AS source FROM fx_points")
def _(p):
    even = C("point_id") % 2 == 0
    lon, lat = C("longitude").alias("Lon"), C("latitude").alias("Lat")
    # positive-down and negative-down files, with columns in another order
    paths = [_written(p.where(even).select(lon, lat, (-C("depth_m")).alias("Depth")), "survey", header="true"), _written(p.where(~even).select(C("depth_m").alias("z_m"), lat, lon), "survey", header="true")]
    return files.survey_points(p.sparkSession, paths).drop("file")


@query("s5_soundings", "fx_points", doubles="x y depth_m", twin="SELECT DISTINCT x, y, depth_m FROM fx_points")
def _(p):
    path = _written(p.select(C("x").alias("easting"), C("y").alias("northing"), C("depth_m").alias("z_m")), "soundings", header="true")
    return files.soundings(p.sparkSession, path).drop("file")


@query("s7_width_stage", "fx_measurements", doubles="width_m stage_m", twin="SELECT CAST(site_no AS VARCHAR) AS site_no, width_ft * 0.3048e0 AS width_m, stage_ft * 0.3048e0 AS stage_m FROM fx_measurements")
def _(m):
    return files.width_stage(m.sparkSession, [_written(m.select(C("site_no").alias("Site"), C("width_ft").alias("Width_ft"), C("stage_ft").alias("Stage_ft")), "width-stage", header="true")])


@query("s8_gage_table", "fx_measurements", doubles="width_ft", twin="SELECT CAST(site_no AS VARCHAR) AS site_no, width_ft FROM fx_measurements")
def _(m):
    spark = m.sparkSession
    head = spark.createDataFrame([(-3, "# made of the tables"), (-2, "site_no\twidth_ft"), (-1, "5s\t12n")], "k long, value string")
    head = head.withColumn("part", F.explode(F.array(*map(F.lit, range(4)))))  # each file has its own
    lines = head.unionByName(m.select(C("meas_id").alias("k"), F.concat_ws("\t", C("site_no").cast("string"), C("width_ft").cast("string")).alias("value"), (C("meas_id") % 4).cast("int").alias("part")))
    path = shared_path(spark, "gages")
    lines.repartition("part").sortWithinPartitions("part", "k").select("value", "part").write.partitionBy("part").text(path)
    return files.gage_table(spark, path).select("site_no", C("width_ft").cast("double").alias("width_ft"))


@query("s16_optional_csv", "fx_points", doubles="depth_m", twin="SELECT point_id, depth_m FROM fx_points WHERE source = 'extra_xyz'")
def _(p):
    spark, schema = p.sparkSession, "point_id long, depth_m double"
    path = _written(p.where(C("source") == "extra_xyz").select("point_id", "depth_m"), "optional", header="true")
    return files.optional_csv(spark, path, schema).unionByName(files.optional_csv(spark, path + "-missing", schema))


@query(
    "s19_s20_grid_sink", "fx_pixels", doubles="depth",
    twin="SELECT prow // 64 AS tile_r, pcol // 64 AS tile_c, count(*) AS n, avg(b02) AS depth, 'm' AS units, 'up' AS positive FROM fx_pixels GROUP BY 1, 2",
)
def _(px):
    path = shared_path(px.sparkSession, "grid")
    files.write_grid(px.select("prow", "pcol", C("b02").alias("depth")), path, 64, units="m", positive="up")
    back = px.sparkSession.read.parquet(path)
    tags = back.schema["depth"].metadata
    return back.groupBy("tile_r", "tile_c").agg(F.count(F.lit(1)).alias("n"), F.avg("depth").alias("depth")).withColumns({k: F.lit(tags[k]) for k in ("units", "positive")})


@query(
    "s21_xyz_sink", "fx_pixels", doubles="x y depth_m weight sigma",
    twin="SELECT x, y, b02 AS depth_m, round(least(1e0, greatest(1e-2, 5e-1 / greatest(s, 1e-1))), 4) AS weight, s AS sigma FROM (SELECT *, 0.1 * (cell % 7 + 3) AS s FROM fx_pixels)",
)
def _(px):
    path = shared_path(px.sparkSession, "xyz")
    files.write_xyz(px.select("x", "y", C("b02").alias("depth_m"), (0.1 * (C("cell") % 7 + 3)).alias("sigma")), path, 0.5)
    return px.sparkSession.read.schema("x double, y double, depth_m double, weight double, sigma double").csv(path, sep=" ")


@query(
    "s22_training_sink", "fx_points", doubles="depth_m",
    twin="""SELECT split, count(*) AS n, avg(depth_m) AS depth_m FROM (SELECT 'all' AS split, depth_m FROM fx_points UNION ALL SELECT CASE WHEN point_id % 5 = 0 THEN 'test' ELSE 'train' END, depth_m FROM fx_points) GROUP BY split""",
)
def _(p):
    path = shared_path(p.sparkSession, "training")
    files.write_training(p.select("point_id", "depth_m", (C("point_id") % 5 == 0).alias("is_test")), path)
    return p.sparkSession.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("depth_m").alias("depth_m"))


@query(
    "s6_tie_points", "fx_points", doubles="depth_m",
    twin="SELECT point_id, depth_m FROM fx_points WHERE source IN ('atl03', 'atl24')",
)
def _(p):
    """Layers train and test of a written training set, or all of it where those are missing."""
    path = shared_path(p.sparkSession, "layers")
    files.write_training(p.select("point_id", "depth_m", "source", (C("point_id") % 5 == 0).alias("is_test")), path)
    return files.tie_points(p.sparkSession, path, ("train", "test"), positive_down=False).where(C("source").isin("atl03", "atl24")).select("point_id", "depth_m")


@query(
    "s4_high_quality_points", "fx_points", doubles="x y z uncertainty",
    twin="SELECT x, y, depth_m AS z, CASE WHEN point_id % 3 > 0 THEN 1e-1 * (point_id % 4) END AS uncertainty FROM fx_points",
)
def _(p):
    path = _written(p.select(C("x").alias("Easting"), C("y").alias("Northing"), C("depth_m").alias("Elevation"), F.when(C("point_id") % 3 > 0, 0.1 * (C("point_id") % 4)).alias("TVU")), "quality", header="true")
    return files.high_quality_points(p.sparkSession, [path])


@query("a25_quantile_edges", "fx_points", doubles="edge", twin="SELECT CAST(unnest(range(0, 9)) AS INT) AS i, unnest(q) AS edge FROM (SELECT quantile_cont(-depth_m, [0e0, 0.125e0, 0.25e0, 0.375e0, 0.5e0, 0.625e0, 0.75e0, 0.875e0, 1e0]) AS q FROM fx_points)")
def _(p):
    return modelling.quantile_edges(p.select((-C("depth_m")).alias("d")), "d", 8)

"""Joins of a row a section or point don't send a side through the driver, however small its files are."""

from pyspark.sql import functions as F

from shoalspark.operators import joins, rivers, sections
from shoalspark.session import checkpointed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_beds_and_levels_are_joined_by_shuffles(spark):
    samples = spark.range(500).selectExpr("id div 25 AS xs_id", "id % 25 * 1e0 AS dist_m", "1e0 AS z", "1e0 AS z_second")
    columns = "left_m right_m wse_m bank_min_m depth_m sigma_m".split()
    x = checkpointed(spark.range(20).select(F.col("id").alias("xs_id"), *(F.lit(float(i * 5)).alias(c) for i, c in enumerate(columns))))
    banks = spark.range(20).selectExpr("id AS xs_id", "1e0 AS left_z", "2e0 AS right_z")
    for df, rows in ((rivers.bed_points(samples, x), 120), (sections.water_levels(samples, banks), 20)):
        assert "Broadcast" not in plan(df) and df.count() == rows


def test_points_meet_pixels_by_a_shuffle(spark):
    points = checkpointed(spark.range(30).selectExpr("id AS point_id", "id * 1e0 AS x", "-id * 1e0 AS y"))
    pixels = checkpointed(spark.range(9).selectExpr("int(id div 3) AS prow", "int(id % 3) AS pcol", "1e-2 * id AS b02"))
    got = joins.sampled_at(points, pixels, ["b02"], 0.0, 0.0, 10.0)
    assert "Broadcast" not in plan(got) and got.count() == 30

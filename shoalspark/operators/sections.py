"""Sections, training rows and summaries in small steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.session import shuffled


def water_levels(samples: DataFrame, banks: DataFrame, band: float = 0.10, quantile: float = 0.10, least: int = 3, drop_m: float = 0.5) -> DataFrame:
    """Water level of each section: a low quantile of the samples (xs_id, dist_m, z, z_second) in the middle band of its length (a metre to either side at least),
    of the second raster where the first has too few, else the lower bank (xs_id, left_z, right_z) less a drop."""
    length = samples.groupBy("xs_id").agg(F.max("dist_m").alias("_len"))
    middle = samples.join(shuffled(length), "xs_id").where(F.abs(F.col("dist_m") - F.col("_len") / 2) <= F.greatest(F.lit(1.0), band * F.col("_len") / 2))
    low = lambda c: F.when(F.count(c) >= least, F.percentile(c, F.lit(quantile)))
    level = middle.groupBy("xs_id").agg(F.coalesce(low("z"), low("z_second")).alias("_level"))
    return banks.join(shuffled(level), "xs_id", "left").select("xs_id", F.coalesce("_level", F.least("left_z", "right_z") - drop_m).alias("wse_m"))


def bank_positions(samples: DataFrame) -> DataFrame:
    """Bank distances and width of each section from flagged samples (xs_id, dist_m, is_left, is_right); null where a flag is missing."""
    one = samples.groupBy("xs_id").agg(F.min(F.when(F.col("is_left"), F.col("dist_m"))).alias("left_m"), F.max(F.when(F.col("is_right"), F.col("dist_m"))).alias("right_m"))
    return one.withColumn("width_m", F.abs(F.col("right_m") - F.col("left_m")))


def collapsed(points: DataFrame, value: str, x0: float, y0: float, size: float, reducer: str = "min") -> DataFrame:
    """One value a pixel: the deepest, or the median."""
    row, col = F.floor((y0 - F.col("y")) / size).cast("int").alias("prow"), F.floor((F.col("x") - x0) / size).cast("int").alias("pcol")
    return points.where(F.col(value).isNotNull()).groupBy(row, col).agg((F.median if reducer == "median" else F.min)(value).alias(value))


def thalweg(points: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Deepest point of each section; the lesser key of equals."""
    return points.where(F.col(value).isNotNull()).groupBy(group).agg(F.min(F.struct(value, key)).alias("_m")).select(group, "_m.*")


def sanitised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Complete rows, with values that aren't finite taken as missing."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    return df.withColumns({c: finite(c) for c in columns}).dropna(subset=columns)


def with_survey_rows(split: DataFrame, survey: Column) -> DataFrame:
    """Training rows: those of the split and all survey rows, each once."""
    return split.where(~F.col("is_test") | survey)


def variance_summary(df: DataFrame, variances: list[str]) -> DataFrame:
    """Mean, median and largest sigma of each variance column and its share of the total, in one pass."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(v).alias("component"), F.col(v).alias("v")) for v in variances))).alias("e")).select("e.*")
    each = long.groupBy("component").agg(F.avg(F.sqrt("v")).alias("mean_m"), F.median(F.sqrt("v")).alias("median_m"), F.max(F.sqrt("v")).alias("most_m"), F.sum("v").alias("_sum"))
    total = each.agg(F.sum("_sum").alias("_total"))  # one row
    return each.crossJoin(F.broadcast(total)).select("component", "mean_m", "median_m", "most_m", F.try_divide("_sum", "_total").alias("share"))


def tile_weights(areas: DataFrame, tile: str, area: str) -> DataFrame:
    """Each tile's share of the area; one row a tile, so the total is one row."""
    each = areas.groupBy(tile).agg(F.sum(area).alias("_area"))
    return each.crossJoin(F.broadcast(each.agg(F.sum("_area").alias("_total")))).select(tile, F.try_divide("_area", "_total").alias("weight"))

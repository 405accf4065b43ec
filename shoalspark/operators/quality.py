"""Data-quality checks: each gives rows (check, passed, value, message, critical)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, value: Column, passed: Callable[[Column], Column], message: str, critical: bool = True) -> DataFrame:
    """One check over one aggregate of a table."""
    one = df.agg(value.cast("double").alias("value"))
    ok = F.coalesce(passed(F.col("value")), F.lit(False))
    return one.select(F.lit(name).alias("check"), ok.alias("passed"), "value", F.when(ok, "ok").otherwise(message).alias("message"), F.lit(critical).alias("critical"))


def source_present(df: DataFrame, source: str = "extra_xyz") -> DataFrame:
    return check(df, f"{source}_present", F.count_if(F.col("source") == source), lambda v: v > 0, f"no {source} rows")


def mean_weight_near(df: DataFrame, source: str, expected: float) -> DataFrame:
    return check(df, f"{source}_weight", F.avg(F.when(F.col("source") == source, F.col("sample_weight"))), lambda v: F.abs(v - expected) <= 0.1 * expected, "weight is off by more than a tenth", False)


def enough_rows(df: DataFrame, least: int = 100) -> DataFrame:
    return check(df, "enough_rows", F.count(F.lit(1)), lambda v: v >= least, f"fewer than {least} rows")


def rmse_below(df: DataFrame, truth: str, predicted: str, limit: float = 2.0) -> DataFrame:
    return check(df, "rmse", F.sqrt(F.avg(F.pow(F.col(predicted) - F.col(truth), F.lit(2.0)))), lambda v: v < limit, f"RMSE is not below {limit}")


def depth_sign(df: DataFrame, depth: str = "depth_m", most: float = 0.9) -> DataFrame:
    return check(df, "depth_sign", F.avg((F.col(depth) > 0).cast("double")), lambda v: v <= most, "depths are positive where they should be negative-down")


def validated(metrics: DataFrame, source: str) -> DataFrame:
    """Whether a by-source accuracy table (source, n) has rows of the source."""
    return check(metrics, f"{source}_validated", F.sum(F.when(F.col("source") == source, F.col("n"))), lambda v: v > 0, f"no validation rows of {source}")


def fewer_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether sampling left fewer rows; the value is the share that it left."""
    counts = after.agg(F.count(F.lit(1)).alias("_after")).crossJoin(before.agg(F.count(F.lit(1)).alias("_before")))  # one row each
    return check(counts, "sampling_reduced", F.max(F.try_divide("_after", "_before")), lambda v: v < 1, "sampling left all rows", False)


def same_grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row ``grids`` tables agree in frame, origin, cell and size."""
    cols = [c for c in a.columns if c in b.columns]
    both = a.select(*(F.col(c).alias(f"a_{c}") for c in cols)).crossJoin(b.select(*(F.col(c).alias(f"b_{c}") for c in cols)))  # one row each
    return check(both, "same_grid", F.sum(sum((~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("int") for c in cols)), lambda v: v == 0, "grids differ")


def nonfinite_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, NaNs and infinities by column."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("e")).select("e.*")
    bad = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("nonfinite"))


def prediction_sanity(df: DataFrame, depth: str, trained: tuple[float, float], least: int = 100) -> DataFrame:
    """One row on predicted depths: counts, shares, range, ``status`` (ok or error) and ``messages`` joined by semicolons."""
    v = F.when(~F.isnan(depth) & (F.abs(F.col(depth)) < float("inf")), F.col(depth))
    share = lambda condition: F.try_divide(F.count_if(condition), F.count(v))
    one = df.agg(
        F.count(F.lit(1)).alias("n_total"), F.count(v).alias("n_finite"), share(v == 0).alias("zero_share"), share(v < 0).alias("negative_share"), share(v > 0).alias("positive_share"),
        F.stddev_pop(v).alias("std_m"), F.avg(v).alias("mean_m"), F.min(v).alias("least_m"), F.max(v).alias("most_m"),
    )
    low, high = trained
    none, zeros = F.col("n_finite") == 0, F.col("zero_share") > 0.99
    messages = F.concat_ws(
        "; ",
        F.when(none, "no finite value").when(F.col("n_finite") < least, "few finite values"), F.when(zeros, "nearly all zero").when(F.col("zero_share") > 0.5, "mostly zero"),
        F.when((F.col("std_m") < 0.01) & (F.col("n_finite") > 1000), "nearly constant"), F.when((F.col("least_m") < low - 5) | (F.col("most_m") > high + 5), "beyond the trained range"),
        F.when(F.lit(low < 0 and high < 0) & (F.col("positive_share") > 0.2), "sign differs from training"),
    )
    return one.withColumn("status", F.when(none | zeros, "error").otherwise("ok")).withColumn("messages", messages)


def river_summary(edges: DataFrame, sections: DataFrame, inferred: DataFrame) -> DataFrame:
    """Long table (step, statistic, value) on a river run: its network (length_m, stream_order), sections (width_m) and inferred depths (depth_m)."""
    number = lambda c: c.cast("double")

    def rows(df: DataFrame, step: str, stats: dict[str, Column]) -> DataFrame:
        one = df.agg(*(number(c).alias(k) for k, c in stats.items()))
        return one.select(F.lit(step).alias("step"), F.explode(F.array(*(F.struct(F.lit(k).alias("statistic"), F.col(k).alias("value")) for k in stats))).alias("e")).select("step", "e.*")

    network = {"segments": F.count(F.lit(1)), "length_km": F.sum("length_m") / 1000, "with_order": F.count_if(F.col("stream_order") > 0), "most_order": F.max("stream_order")}
    section = {"sections": F.count(F.lit(1)), "mean_width_m": F.avg("width_m"), "most_width_m": F.max("width_m")}
    depth = {"valid": F.count("depth_m"), "mean_depth_m": F.avg("depth_m"), "most_depth_m": F.max("depth_m")}
    return reduce(DataFrame.unionByName, (rows(edges, "network", network), rows(sections, "sections", section), rows(inferred, "inference", depth)))


class Suite:
    """Checks, built in and added, and their pass rate."""

    def __init__(self) -> None:
        self.checks: list[DataFrame] = []

    def add(self, rows: DataFrame) -> Suite:
        self.checks.append(rows)
        return self

    def run(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.checks)

    def summary(self) -> DataFrame:
        return self.run().agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.count_if(~F.col("passed") & F.col("critical")).alias("critical_failures"))


def area_messages(west: Column, east: Column, south: Column, north: Column) -> Column:
    """What is wrong with a box in degrees."""
    return F.array_compact(
        F.array(
            F.when(west >= east, "west is not below east"), F.when(south >= north, "south is not below north"), F.when((west < -180) | (east > 180), "longitude out of range"),
            F.when((south < -90) | (north > 90), "latitude out of range"), F.when(((east - west) > 5) | ((north - south) > 5), "area is very large"),
        )
    )


def date_messages(start: Column, end: Column, today: Column | None = None) -> Column:
    """What is wrong with a range of dates given as text; errors end the list, warnings are on ranges that hold few scenes, too many, or none yet."""
    today = F.current_date() if today is None else today
    a, b = (F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date")) for c in (start, end))
    days = F.date_diff(b, a)
    first_scene = F.lit("2015-06-23").cast("date")  # no scene is older
    error = F.when(a.isNull(), "error: start isn't a date").when(b.isNull(), "error: end isn't a date").when(days < 0, "error: end is before start")
    warnings = F.array_compact(
        F.array(
            F.when(days == 0, "warning: a single day").when(days > 3 * 365, "warning: longer than three years"), F.when(a > today, "warning: start is to come"), F.when(b > today, "warning: end is to come"),
            F.when(a < first_scene, "warning: start is before the first scenes"),
        )
    )
    return F.when(error.isNotNull(), F.array(error)).otherwise(warnings)


def depth_messages(deepest: Column, rmse: Column, width: Column, limit: float = 50.0) -> Column:
    """What is wrong with a depth limit (text: a number or ``auto``), an error aimed at and a bin's width; nulls aren't judged."""
    d = deepest.try_cast("double")
    named = F.lower(F.trim(deepest)) == "auto"
    return F.array_compact(
        F.array(
            F.when(~named & d.isNull(), "error: depth limit isn't a number or auto").when(d <= 0, "error: depth limit isn't positive").when(d > limit, "error: depth limit is beyond what light reaches").when(d > 25, "warning: depth limit is deep"),
            F.when(rmse <= 0, "error: aimed error isn't positive").when(rmse < 0.1, "warning: aimed error is strict").when(rmse > 3, "warning: aimed error is lax"),
            F.when(width <= 0, "error: bin isn't positive").when(width < 0.25, "warning: bin is narrow").when(width > 5, "warning: bin is wide"),
        )
    )

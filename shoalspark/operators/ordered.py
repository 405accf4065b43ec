"""Windows and running aggregates over long ordered groups (tracks, rivers) without a task that holds one of them.

Rows are dealt by ranges of (group, order) and numbered; a group is then cut into runs of
as many places each. A window of a few places meets the border rows of the runs beside
it; a running aggregate is made within runs, and carried on from run to run through a
table of one row a run. A group that a third of all rows belong to is thus many even tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalspark.session import checkpointed

RUN = 4096
#: Columns that ``placed`` adds: the group, the place in it from 0, and the run of places.
GROUP, PLACE, PART = "_g", "_i", "_run"


def placed(df: DataFrame, group: list[str], order: list[str], run: int = RUN) -> DataFrame:
    """Rows with their group (nulls are a group), place and run; equal rows of the order get any of their places."""
    keyed = df.withColumn(GROUP, F.struct(*group))
    ranged = checkpointed(keyed.repartitionByRange(GROUP, *order).withColumn("_p", F.spark_partition_id()))
    piece = ranged.groupBy(GROUP, "_p").agg(F.count(F.lit(1)).alias("_k"))  # one row a group and range
    piece = piece.withColumn("_first", F.sum("_k").over(Window.partitionBy(GROUP).orderBy("_p")) - F.col("_k")).drop("_k")
    at = F.col("_first") + F.row_number().over(Window.partitionBy(GROUP, "_p").orderBy(*order)) - 1
    return checkpointed(ranged.join(piece, [GROUP, "_p"]).withColumn(PLACE, at).withColumn(PART, F.floor(F.col(PLACE) / run)).drop("_p", "_first"))


def windowed(rows: DataFrame, reach: int, columns: Callable[[DataFrame, Window], DataFrame], run: int = RUN) -> DataFrame:
    """``columns(rows, window)`` where the window is a group's order and looks at most ``reach`` places back or ahead, all columns together."""
    if reach >= run:
        raise ValueError("a window must reach less far than a run")
    at = F.pmod(F.col(PLACE), F.lit(run))
    copies = F.array_compact(F.array(F.lit(0), F.when((at < reach) & (F.col(PART) > 0), F.lit(-1)), F.when(at >= run - reach, F.lit(1))))
    spread = rows.withColumn("_to", F.explode(copies)).withColumns({"_own": F.col("_to") == 0, PART: F.col(PART) + F.col("_to")}).drop("_to")
    return columns(spread, Window.partitionBy(GROUP, PART).orderBy(PLACE)).where("_own").drop("_own")


def running(rows: DataFrame, **aggregates: tuple[str, Column]) -> DataFrame:
    """Adds ``name = ("sum" | "max" | "count", column)`` over each group's rows up to the current one; nulls take no part."""
    make = {"sum": F.sum, "max": F.max, "count": F.count}
    join = {"sum": lambda a, b: F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(a + b), "max": F.greatest, "count": lambda a, b: F.coalesce(a, F.lit(0)) + b}
    upto = Window.partitionBy(GROUP, PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(GROUP, PART).agg(*(make[kind](c).alias(f"_t_{n}") for n, (kind, c) in aggregates.items()))
    earlier = Window.partitionBy(GROUP).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    over = {"sum": F.sum, "max": F.max, "count": F.sum}
    carry = totals.select(GROUP, PART, *(over[kind](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, (kind, _) in aggregates.items()))
    local = rows.withColumns({f"_l_{n}": make[kind](c).over(upto) for n, (kind, c) in aggregates.items()})
    out = local.join(carry, [GROUP, PART])
    out = out.withColumns({n: join[kind](F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (kind, _) in aggregates.items()})
    return out.drop(*(f"_{x}_{n}" for n in aggregates for x in "lc"))


def filled(rows: DataFrame, known: Column) -> DataFrame:
    """Adds ``_before`` and ``_after``: the last ``known`` that isn't null up to a row, and the first one from it on, in its group."""
    rows = rows.withColumn("_known", known)
    # the next known is the last one of the falling order: a frame up to the end would be read again from each row on
    w = Window.partitionBy(GROUP, PART)
    local = rows.withColumn("_after", F.last("_known", ignorenulls=True).over(w.orderBy(F.col(PLACE).desc()).rowsBetween(Window.unboundedPreceding, 0)))
    local = local.withColumn("_before", F.last("_known", ignorenulls=True).over(w.orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)))
    at = F.when(F.col("_known").isNotNull(), F.col(PLACE))
    ends = rows.groupBy(GROUP, PART).agg(F.max_by("_known", at).alias("_last"), F.min_by("_known", at).alias("_first"))  # one row a run
    runs = Window.partitionBy(GROUP)
    carry = ends.withColumn("_later", F.last("_first", ignorenulls=True).over(runs.orderBy(F.col(PART).desc()).rowsBetween(Window.unboundedPreceding, -1)))
    carry = carry.select(GROUP, PART, F.last("_last", ignorenulls=True).over(runs.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"), "_later")
    out = local.join(carry, [GROUP, PART])
    return out.withColumns({"_before": F.coalesce("_before", "_earlier"), "_after": F.coalesce("_after", "_later")}).drop("_known", "_earlier", "_later")


def plain(rows: DataFrame) -> DataFrame:
    """Without the columns that ``placed`` added."""
    return rows.drop(GROUP, PLACE, PART)

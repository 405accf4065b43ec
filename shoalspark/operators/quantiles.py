"""Exact quantiles of large columns without one reducer that holds a column's distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalspark.session import checkpointed


def exact_quantiles(df: DataFrame, values: dict[str, Column], wanted: dict[str, tuple[str, float]], by: tuple[str, ...] = ()) -> DataFrame:
    """One row a group of ``by`` with the ``wanted`` (value name, probability) as columns, interpolated as ``percentile`` does.

    Distinct values with their counts are dealt by ranges; counts a range tell which ranges hold
    the ranks looked for, and only those are sorted, each by itself. A value that a third of all
    rows share is one row by then. Nulls take no part; a group without values has no row, the
    whole table (no ``by``) always has one.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_one"))  # equal as a struct even where a key is null
    each = F.array(*(F.struct(F.lit(n).alias("c"), v.cast("double").alias("v")) for n, v in values.items()))
    long = df.select(group.alias("_g"), F.explode(each).alias("_e")).select("_g", F.col("_e.c").alias("_c"), F.col("_e.v").alias("_v")).where(F.col("_v").isNotNull())
    counts = long.groupBy("_g", "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = checkpointed(counts.repartitionByRange("_g", "_c", "_v").withColumn("_p", F.spark_partition_id()))
    piece = ["_g", "_c", "_p"]
    whole = Window.partitionBy("_g", "_c")
    pieces = placed.groupBy(*piece).agg(F.sum("_n").alias("_k")).withColumns({"_to": F.sum("_k").over(whole.orderBy("_p")), "_all": F.sum("_k").over(whole)})
    ranks = F.explode(F.array(*(F.struct(F.lit(a).alias("name"), F.lit(c).alias("c"), F.lit(float(p)).alias("p")) for a, (c, p) in wanted.items())))
    at = pieces.withColumn("_w", ranks).where(F.col("_w.c") == F.col("_c")).withColumns({"_name": F.col("_w.name"), "_at": F.col("_w.p") * (F.col("_all") - 1), "_before": F.col("_to") - F.col("_k")})
    at = at.withColumns({"_lo": F.floor("_at"), "_hi": F.ceil("_at")}).where((F.col("_lo") < F.col("_to")) & (F.col("_hi") >= F.col("_before")))
    needed = at.select(*piece, "_before", "_name", "_at", "_lo", "_hi")
    rows = placed.join(needed.select(*piece, "_before").distinct(), piece)
    rows = rows.withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy(*piece).orderBy("_v"))).withColumn("_from", F.col("_to") - F.col("_n")).drop("_before")
    held = lambda r: F.max(F.when((F.col(r) >= F.col("_from")) & (F.col(r) < F.col("_to")), F.col("_v")))
    found = rows.join(needed.drop("_before"), piece).groupBy("_g", "_name").agg(held("_lo").alias("_a"), held("_hi").alias("_b"), F.max("_at").alias("_at"))
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.floor("_at")) * F.col("_b"))
    named = [F.max(F.when(F.col("_name") == n, value)).alias(n) for n in wanted]
    if not by:
        return found.agg(*named)
    return found.groupBy("_g").agg(*named).select("_g.*", *wanted)


def with_quantiles(stats: DataFrame, quantiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates of the same table and groups, one row a group, with their quantiles."""
    if not by:
        return stats.crossJoin(F.broadcast(quantiles))  # one row each
    keyed = quantiles.withColumnsRenamed({c: f"_k_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return stats.join(keyed, cond, "left").drop(*(f"_k_{c}" for c in by))

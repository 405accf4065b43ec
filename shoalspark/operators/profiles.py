"""River profiles and networks: smoothing, monotone and isotonic fits, slopes, components, stationing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalspark.functions.optics import clip
from shoalspark.operators import ordered
from shoalspark.operators.quantiles import exact_quantiles, with_quantiles
from shoalspark.session import checkpointed


def rolling_smooth(df: DataFrame, group: str, order: str, value: str, window: int, least: int) -> DataFrame:
    """Centred rolling median, then rolling mean, over an odd window; null with fewer than ``least`` values."""
    h = (window | 1) // 2

    def smoothed(rows: DataFrame, w: Window) -> DataFrame:
        w = w.rowsBetween(-h, h)
        held = F.array_sort(F.collect_list(value).over(w))  # a window's few values; medians have no frames of their own
        n = F.size(held)
        mid = (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2
        mean = F.when(F.count("_med").over(w) >= least, F.avg("_med").over(w))
        return rows.withColumn("_med", F.when(n >= least, mid)).withColumn("smooth", mean).drop("_med")

    run = max(ordered.RUN, 8 * h)
    return ordered.plain(ordered.windowed(ordered.placed(df, [group], [order], run), 2 * h, smoothed, run))


def _pooled(mean: np.ndarray, size: np.ndarray) -> tuple[list, list]:
    """Pool adjacent violators of weighted means."""
    means, sizes = [], []
    for m, n in zip(mean.tolist(), size.tolist(), strict=True):
        while means and means[-1] > m:
            k = sizes.pop()
            m, n = (means.pop() * k + m * n) / (k + n), k + n
        means.append(m)
        sizes.append(n)
    return means, sizes


def isotonic(df: DataFrame, group: str, order: str, value: str, increasing: bool | Column = True, run: int = 4096) -> DataFrame:
    """Pool-adjacent-violators fit of each group's profile, added as ``fitted``; a column tells each group's direction where they differ.

    Rows go by ``order``, equal ones by the value in the trend's direction; a null value takes no
    part and gets null. Profiles are cut into runs of ``run`` positions that are pooled in parallel.
    Neighbouring runs then merge in log rounds: only blocks above the right side's least or below
    the left side's largest mean meet in a task, all others stay as they are. A profile that a
    third of all rows belong to is thus never in one task.
    """
    sign = F.when(increasing if isinstance(increasing, Column) else F.lit(increasing), 1.0).otherwise(-1.0)
    known = df.where(F.col(value).isNotNull()).withColumns({"_g": F.struct(group), "_v": sign * F.col(value).cast("double")})
    ranged = checkpointed(known.repartitionByRange("_g", order, "_v").withColumn("_p", F.spark_partition_id()))
    piece = ranged.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_k"))  # rows of a profile in a range
    piece = piece.withColumn("_first", F.sum("_k").over(Window.partitionBy("_g").orderBy("_p")) - F.col("_k"))
    at = F.col("_first") + F.row_number().over(Window.partitionBy("_g", "_p").orderBy(order, "_v")) - 1
    rows = checkpointed(ranged.join(piece, ["_g", "_p"]).withColumn("_i", at).withColumn("_run", F.floor(F.col("_i") / run)).drop("_p", "_k", "_first"))
    schema = f"_g {rows.schema['_g'].dataType.simpleString()}, _run long, _i long, _mean double, _size long"

    def pooled(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", kind="stable")
        mean, size = _pooled(pdf["_mean"].to_numpy(float), pdf["_size"].to_numpy())
        first = pdf["_i"].iloc[0] + np.cumsum([0, *size[:-1]])
        return pd.DataFrame({"_g": [key[0]] * len(size), "_run": key[1], "_i": first, "_mean": mean, "_size": size})

    cells = rows.select("_g", "_run", "_i", F.col("_v").alias("_mean"), F.lit(1).cast("long").alias("_size"))
    blocks = checkpointed(cells.groupBy("_g", "_run").applyInPandas(pooled, schema))
    runs = (blocks.agg(F.max("_run")).first()[0] or 0) + 1  # one number
    while runs > 1:
        left = F.col("_run") % 2 == 0
        pair = F.floor(F.col("_run") / 2)
        ends = blocks.groupBy("_g", pair.alias("_pair")).agg(F.max(F.when(left, F.col("_mean"))).alias("_top"), F.min(F.when(~left, F.col("_mean"))).alias("_low"))
        known_ends = blocks.withColumn("_pair", pair).join(ends, ["_g", "_pair"])
        clash = F.coalesce(F.when(left, F.col("_mean") > F.col("_low")).otherwise(F.col("_mean") < F.col("_top")), F.lit(False))
        marked = known_ends.withColumn("_clash", clash).withColumn("_run", F.col("_pair")).select("_g", "_run", "_i", "_mean", "_size", "_clash")
        merged = marked.where("_clash").drop("_clash").groupBy("_g", "_run").applyInPandas(pooled, schema)
        blocks = checkpointed(marked.where("not _clash").drop("_clash").unionByName(merged))
        runs = (runs + 1) // 2
    over = F.explode(F.sequence(F.floor(F.col("_i") / run), F.floor((F.col("_i") + F.col("_size") - 1) / run)))
    marks = blocks.select("_g", F.col("_i").alias("_start"), "_mean", over.alias("_run")).select("_g", "_run", F.greatest(F.col("_start"), F.col("_run") * run).alias("_i"), "_mean")
    w = Window.partitionBy("_g", "_run").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    fitted = rows.join(marks, ["_g", "_run", "_i"], "left").withColumn("fitted", sign * F.last("_mean", ignorenulls=True).over(w)).select(*df.columns, "fitted")
    return fitted.unionByName(df.where(F.col(value).isNull()).withColumn("fitted", F.lit(None).cast("double")))


def surface_profile(df: DataFrame, group: str = "river_id", order: str = "s_center_m", value: str = "wse_m", window: int = 9) -> DataFrame:
    """Smoothed water surface, isotonic in the direction of its trend, and its slope."""
    smooth = rolling_smooth(df, group, order, value, window, max(3, window // 2))
    trend = smooth.groupBy(group).agg(F.coalesce(F.covar_pop(order, "smooth") > 0, F.lit(False)).alias("_up"))
    known = smooth.where(F.col("smooth").isNotNull()).join(trend, group)
    return central_slope(isotonic(known, group, order, "smooth", F.col("_up")).drop("_up"), group, order, "fitted")


def central_slope(df: DataFrame, group: str, order: str, value: str, low: float = 1e-5, high: float = 0.05) -> DataFrame:
    def sloped(rows: DataFrame, w: Window) -> DataFrame:
        rise = F.abs(F.lead(value).over(w) - F.lag(value).over(w))
        return rows.withColumn("slope", clip(F.try_divide(rise, F.lead(order).over(w) - F.lag(order).over(w)), low, high))

    return ordered.plain(ordered.windowed(ordered.placed(df, [group], [order]), 1, sloped))


def monotone_depth(df: DataFrame, group: str, order: str, depth: str, eps: float = 0.0) -> DataFrame:
    """Depth that never falls by more than ``eps`` a section downstream: a running maximum of d + eps k, less eps k."""
    counted = ordered.running(ordered.placed(df, [group], [order]), _k=("count", F.col(depth)))
    raised = ordered.running(counted, _top=("max", F.col(depth) + eps * F.col("_k")))
    return ordered.plain(raised.withColumn("adjusted_m", F.when(F.col(depth).isNotNull(), F.col("_top") - eps * F.col("_k"))).drop("_k", "_top"))


def moving_average_bed(df: DataFrame, group: str, order: str, value: str, smooth_m: float) -> DataFrame:
    """Moving average over a window from the group's median spacing; ends repeat beyond the profile."""
    step = ordered.windowed(ordered.placed(df, [group], [order]), 1, lambda rows, w: rows.withColumn("_ds", F.lead(order).over(w) - F.col(order)))
    # running sums make every window one difference, whatever its width
    step = checkpointed(ordered.running(step, _sum=("sum", F.col(value))).withColumn("_i", F.col("_i") + 1))
    spacing = exact_quantiles(step.where(F.col("_ds").isNotNull()), {"ds": F.col("_ds")}, {"_mid": ("ds", 0.5)}, by=(group,))
    ends = step.groupBy(group).agg(F.count(F.lit(1)).alias("_len"), F.min_by(value, "_i").alias("_first"), F.max_by(value, "_i").alias("_last"))
    n = with_quantiles(ends, spacing, by=(group,)).withColumn("_n", F.least("_len", F.greatest(F.lit(3), F.rint(smooth_m / F.col("_mid")))).cast("int")).drop("_mid")
    rows = step.drop("_sum").join(n, group).withColumn("_lo", F.col("_i") - F.floor(F.col("_n") / 2)).withColumn("_hi", F.col("_lo") + F.col("_n") - 1)
    run = step.select(group, F.col("_i").alias("_j"), "_sum")
    top = rows.withColumn("_j", F.least("_hi", "_len")).join(run, [group, "_j"]).drop("_j").withColumnRenamed("_sum", "_s1")
    low = top.withColumn("_j", F.col("_lo") - 1).join(run, [group, "_j"], "left").drop("_j").withColumn("_s0", F.coalesce("_sum", F.lit(0.0)))
    missing = F.greatest(F.lit(0), 1 - F.col("_lo")) * F.col("_first") + F.greatest(F.lit(0), F.col("_hi") - F.col("_len")) * F.col("_last")
    return low.withColumn("bed_est_m", (F.col("_s1") - F.col("_s0") + missing) / F.col("_n")).select(*df.columns, "bed_est_m")


def support_depth(bins: DataFrame, target: float = 0.5, least: int = 20, bridge: int = 4) -> DataFrame:
    """Deepest bin reached strictly (every bin full and within the target) and relaxed (short runs of sparse bins bridged).

    ``bins``: (bin, hi, n, rmse), one row a depth bin, so that windows over all of them are small.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sparse = F.col("n") < least
    fails = ~sparse & (F.col("rmse") > target)
    b = bins.withColumn("_sparse", sparse).withColumn("_fail", fails)
    b = b.withColumn("_strict", F.max((F.col("_sparse") | F.col("_fail")).cast("int")).over(w) == 0)
    b = b.withColumn("_run", F.sum((~F.col("_sparse")).cast("int")).over(w))
    gap = Window.partitionBy("_run").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_gap", F.sum(F.col("_sparse").cast("int")).over(gap))
    b = b.withColumn("_stop", F.max((F.col("_fail") | (F.col("_gap") > bridge)).cast("int")).over(w) == 1)
    return b.agg(F.max(F.when(F.col("_strict"), F.col("hi"))).alias("strict_m"), F.max(F.when(~F.col("_stop") & ~F.col("_sparse"), F.col("hi"))).alias("relaxed_m"))


# -- networks


def reach_graph(lines: DataFrame, snap_m: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of lines (river_id, coords array of x, y): end points snapped, degree, length."""
    key = lambda p: F.concat_ws(":", F.rint(p["x"] / snap_m).cast("long"), F.rint(p["y"] / snap_m).cast("long"))
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    length = F.expr("aggregate(sequence(2, size(coords)), 0D, (s, i) -> s + sqrt(power(coords[i-1].x - coords[i-2].x, 2) + power(coords[i-1].y - coords[i-2].y, 2)))")
    edges = lines.where(F.size("coords") > 1).select("river_id", key(first).alias("from_node"), key(last).alias("to_node"), length.alias("length_m"))
    nodes = edges.select(F.explode(F.array("from_node", "to_node")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes, edges


def _fixpoint(step, start: DataFrame, key: str, measure: str) -> DataFrame:
    """Repeat a step until no row's ``measure`` changes, cutting the lineage at each; rows are counted, as sums of doubles depend on their order."""
    now = start
    while True:
        before = now.select(key, F.col(measure).alias("_before"))
        both = checkpointed(step(now).join(before, key))
        now = both.drop("_before")
        if both.where(~F.col(measure).eqNullSafe(F.col("_before"))).isEmpty():
            return now


def components(edges: DataFrame) -> DataFrame:
    """``(node, component_id)``, the least node reachable, by labels that halve their chains."""
    both = edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()

    def step(label: DataFrame) -> DataFrame:
        near = both.join(label.select(F.col("node").alias("b"), F.col("component_id").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        low = label.join(near, F.col("node") == F.col("a")).select("node", F.least("component_id", "c").alias("component_id"))
        jump = low.select(F.col("node").alias("component_id"), F.col("component_id").alias("further"))
        return low.join(jump, "component_id").select("node", F.col("further").alias("component_id"))

    return _fixpoint(step, both.select(F.col("a").alias("node"), F.col("a").alias("component_id")).distinct(), "node", "component_id")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "length_m"))


def _simple(pairs: DataFrame) -> DataFrame:
    """The shortest of parallel edges (a < b); loops go."""
    return checkpointed(pairs.where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("length_m").alias("length_m")))


def _chains(pairs: DataFrame, inner: DataFrame) -> DataFrame:
    """``(a, b, head, length_m)``: from each arc a -> b on to the first node that isn't ``inner`` (``node, n1, n2``, its two neighbours), by paths that double each round."""
    onward = inner.select(F.col("node").alias("head"), "n1", "n2")

    def with_next(paths: DataFrame) -> DataFrame:
        after = F.when(F.col("n1") == F.col("before"), F.col("n2")).otherwise(F.col("n1"))
        return paths.join(onward, "head", "left").withColumn("next", F.when(F.col("n1").isNotNull(), after)).drop("n1", "n2")

    paths = with_next(_both(pairs).select("a", "b", F.col("b").alias("head"), F.col("a").alias("before"), "length_m"))
    while True:
        paths = checkpointed(paths)
        if paths.where(F.col("next").isNotNull()).isEmpty():
            return paths.select("a", "b", "head", "length_m")
        tail = paths.select(F.col("a").alias("head"), F.col("b").alias("next"), F.col("head").alias("_head"), F.col("before").alias("_before"), F.col("next").alias("_next"), F.col("length_m").alias("_m"))
        longer = paths.join(tail, ["head", "next"], "left")
        on = F.col("_head").isNotNull()
        paths = longer.select(
            "a", "b", F.when(on, F.col("_head")).otherwise(F.col("head")).alias("head"), F.when(on, F.col("_before")).otherwise(F.col("before")).alias("before"),
            (F.col("length_m") + F.coalesce("_m", F.lit(0.0))).alias("length_m"), F.when(on, F.col("_next")).alias("next"),
        )


def stationed(edges: DataFrame, labels: DataFrame, nodes: DataFrame, hops: int = 4) -> DataFrame:
    """Shortest distance of each node from its component's root.

    The root is the southmost leaf (nodes have ``node``, ``y``), or southmost node of a component without a leaf; the lesser node of equals.
    Leaves are taken off and chains of nodes with two neighbours become one edge, again and
    again, which leaves nothing of a tree after rounds that grow with the logarithm of its size. Only
    what is left (meshes) is relaxed to a fixed point, ``hops`` edges a round. Then chains and leaves come back, last first.
    """
    ends_of = edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b"), "length_m")
    degree = _both(ends_of).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("_degree"))
    ends = labels.join(nodes.select("node", "y"), "node").join(degree, "node")
    root = ends.groupBy("component_id").agg(F.min(F.struct((F.col("_degree") != 1).alias("inner"), "y", "node")).alias("_r")).select("component_id", F.col("_r.node").alias("root"))
    start = checkpointed(labels.join(root, "component_id"))
    roots = start.where(F.col("node") == F.col("root")).select("node")

    def of_degree(pairs: DataFrame, n: int) -> DataFrame:
        near = _both(pairs).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("_k"), F.min("b").alias("n1"), F.max("b").alias("n2"))
        return checkpointed(near.where(F.col("_k") == n).drop("_k").join(roots, "node", "left_anti"))

    pairs, levels = _simple(ends_of), []
    while not pairs.isEmpty():
        leaves = of_degree(pairs, 1).select("node")
        raked = checkpointed(_both(pairs).join(leaves, F.col("a") == F.col("node")).select("node", F.col("b").alias("at"), "length_m"))
        left = pairs.join(raked.select(F.col("node").alias("a")), "a", "left_anti").join(raked.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b", "length_m")
        inner = of_degree(left, 2)
        if raked.isEmpty() and inner.isEmpty():
            break
        paths = _chains(left, inner)
        within = paths.join(inner.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("a").alias("node"), F.col("head").alias("at"), "length_m")
        levels.append((raked, within))
        pairs = _simple(paths.join(inner.select(F.col("node").alias("a")), "a", "left_anti").select("a", F.col("head").alias("b"), "length_m"))
    known = _relaxed(pairs, roots, hops)
    for raked, within in reversed(levels):
        for part in (within, raked):
            found = part.join(known.withColumnRenamed("node", "at"), "at").groupBy("node").agg(F.min(F.col("s_m") + F.col("length_m")).alias("s_m"))
            known = known.unionByName(found.select("node", "s_m"))
        known = checkpointed(known)
    return start.join(known, "node").select("node", "component_id", "s_m")


def _relaxed(pairs: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """``(node, s_m)``: shortest distances from the roots over what is left of the network."""
    begin = roots.select("node", F.lit(0.0).alias("s_m"))
    if pairs.isEmpty():
        return checkpointed(begin)
    both, far = checkpointed(_both(pairs)), 1e12
    others = both.select(F.col("a").alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.lit(far).alias("s_m"))

    def step(now: DataFrame) -> DataFrame:
        for _ in range(hops):
            reach = now.where(F.col("s_m") < far).join(both, F.col("node") == F.col("a")).groupBy("b").agg(F.min(F.col("s_m") + F.col("length_m")).alias("via"))
            now = now.join(reach, F.col("node") == F.col("b"), "left").select("node", F.least("s_m", F.coalesce("via", F.lit(far))).alias("s_m"))
        return now

    return _fixpoint(step, checkpointed(begin.unionByName(others)), "node", "s_m")


def longest_components(edges: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    length = edges.join(labels.withColumnRenamed("node", "from_node"), "from_node").groupBy("component_id").agg(F.sum("length_m").alias("length_m"), F.count(F.lit(1)).alias("edges"))
    return length.orderBy(F.col("length_m").desc(), "component_id").limit(k)


def gated_slope(df: DataFrame, group: str, order: str, value: str, window: int = 7, least: int = 10, correlation: float = 0.7, high: float = 0.05) -> DataFrame:
    """``df`` with ``slope``: size of the gradient of the value's rolling median, where a group's medians follow its order well enough.

    Rows without both numbers have no slope and take no part. A group has slopes if it has ``least`` rows (three at the least), more than one
    place, a median for each row (over an odd window; a third of it, and three, must be there) and a correlation of places and medians of
    ``correlation`` either way. Inside, the gradient is that of the parabola through a row and its neighbours; at the ends, the
    difference to the only neighbour. Rows at one place with a neighbour have no slope, none is above ``high``.
    """
    width = max(3, window) | 1
    h, enough = width // 2, max(3, width // 3)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    known = F.coalesce(finite(order) & finite(value), F.lit(False))

    def sloped(rows: DataFrame, w: Window) -> DataFrame:
        held = F.array_sort(F.collect_list(value).over(w.rowsBetween(-h, h)))
        n = F.size(held)
        mid = (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2
        rows = rows.withColumn("_med", F.when(n >= enough, mid))
        near = {"_ds0": F.col(order) - F.lag(order).over(w), "_ds1": F.lead(order).over(w) - F.col(order), "_dv0": F.col("_med") - F.lag("_med").over(w), "_dv1": F.lead("_med").over(w) - F.col("_med")}
        rows = rows.withColumns(near)
        before, after = F.try_divide("_dv0", "_ds0"), F.try_divide("_dv1", "_ds1")
        both = (before * F.col("_ds1") + after * F.col("_ds0")) / F.nullif(F.col("_ds0") + F.col("_ds1"), F.lit(0.0))
        return rows.withColumn("slope", F.when(F.col("_ds0").isNull(), after).when(F.col("_ds1").isNull(), before).otherwise(both)).drop(*near)

    run = max(ordered.RUN, 8 * h)
    rows = checkpointed(ordered.windowed(ordered.placed(df.where(known), [group], [order], run), h + 1, sloped, run))
    gate = rows.groupBy(ordered.GROUP).agg(F.count(F.lit(1)).alias("_n"), F.count("_med").alias("_m"), F.try_divide(F.covar_pop(order, "_med"), F.stddev_pop(order) * F.stddev_pop("_med")).alias("_corr"), (F.max(order) > F.min(order)).alias("_long"))
    passed = (F.col("_n") >= max(3, least)) & (F.col("_m") == F.col("_n")) & F.col("_long") & ~F.isnan("_corr") & (F.abs("_corr") >= correlation)
    out = rows.join(gate.select(ordered.GROUP, F.coalesce(passed, F.lit(False)).alias("_passed")), ordered.GROUP)
    out = ordered.plain(out.withColumn("slope", F.when(F.col("_passed"), F.least(F.abs("slope"), F.lit(high))))).drop("_passed", "_med")
    return out.unionByName(df.where(~known).withColumn("slope", F.lit(None).cast("double")))

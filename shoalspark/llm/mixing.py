"""Operator 7, mixing sources to target weights by pivotal dependent rounding.

Only DataFrame and SQL functions. ``source_targets`` shares the total size out
by weight and caps each source (water filling by window sums over the table of
sources). Each document then wants target / source size copies; its whole part
is certain and its fraction is a probability with mass fraction x size.

Pivotal rounding pairs two fractional documents and moves mass from one to the
other, in a random direction whose odds keep both expectations, until one's
probability is 0 or 1. A source's mass in all is kept exactly. Pairs are taken
along arrays of about ``block`` documents of like size (a fold); the one
residual of each array goes up a reduction tree, ``block`` arrays to one, until
one document of each source is left, which is rounded to the nearer end.
So a source's words differ from its target by half that document's size at most.

Rows of one source, id and size are numbered (inside each input partition, then
by the partitions' counts, so that no task holds all copies of a row), and draws
and blocks are hashes of id, size and that number: reruns agree, whatever the
partitioning, and copies fall into different blocks.

Defined cases: a null source is a source, last in order; a null or empty text
has size 0 and is never taken; very long texts are one document of their size;
repeated rows draw each for themselves; a null id is an id like any other; ties in
size are ordered by hash and id; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalspark.llm.common import WORD, materialise, text_or_empty

WEIGHTS, CAP, BLOCK = (1.0, 2.0, 3.0), 3.0, 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``(source, source_size, target)`` of a table ``(source, size)`` of documents.

    Weights repeat over the sources in code-point order, null last. A source's
    target stops at ``cap`` times its size; what is cut is shared again by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(1))  # one row a source
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    t = by_source.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    t = t.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    # in order of most / weight, a source is capped while the level shared by it and its successors exceeds that
    order = everything.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("total") - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)["level"]
    return t.select("source", "source_size", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def _unit(u: Column, p: Column) -> Column:
    return F.struct(u["size"].alias("size"), u["draw"].alias("draw"), u["row"].alias("row"), p.alias("p"))


def _step(state: Column, u: Column) -> Column:
    """Meet the next unit: the fractional one of the pair stays in hand, the other is done."""
    a, done = state["hand"], state["done"]
    up = F.least((1 - a["p"]) * a["size"], u["p"] * u["size"])  # what can move from u to a
    down = F.least(a["p"] * a["size"], (1 - u["p"]) * u["size"])  # and from a to u
    toss = (F.pmod(F.xxhash64(a["draw"], u["draw"], F.lit("pivot")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rise = toss * (up + down) < down
    pa = F.when(rise, F.when(up >= (1 - a["p"]) * a["size"], 1.0).otherwise(a["p"] + up / a["size"])).otherwise(
        F.when(down >= a["p"] * a["size"], 0.0).otherwise(a["p"] - down / a["size"])
    )
    pu = F.when(rise, F.when(up >= u["p"] * u["size"], 0.0).otherwise(u["p"] - up / u["size"])).otherwise(
        F.when(down >= (1 - u["p"]) * u["size"], 1.0).otherwise(u["p"] + down / u["size"])
    )
    whole = lambda p: (p <= 0) | (p >= 1)
    out = lambda hand, finished: F.struct(hand.alias("hand"), F.concat(done, F.array(finished)).alias("done"))
    return (
        F.when(a.isNull(), F.struct(u.alias("hand"), done.alias("done")))
        .when(whole(u["p"]), out(a, u))
        .when(whole(a["p"]), out(u, a))
        .when(whole(pu), out(_unit(a, pa), _unit(u, pu)))
        .otherwise(out(_unit(u, pu), _unit(a, pa)))
    )


def _fold(units: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Pivotal rounding inside each group; every unit comes back, at most one of a group fractional."""
    kind = f"struct<size:bigint,draw:bigint,row:{units.schema['row'].dataType.simpleString()},p:double>"
    start = F.expr(f"named_struct('hand', cast(null as {kind}), 'done', cast(array() as array<{kind}>))")
    grouped = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("size", "draw", "row", "p"))).alias("u"), *(F.first(c).alias(c) for c in carried))
    done = F.aggregate("u", start, _step, lambda s: F.concat(s["done"], F.array(s["hand"])))
    return grouped.select(*keys, *carried, F.explode(done).alias("x")).select(*keys, *carried, "x.*")


def _numbered(sized: DataFrame) -> DataFrame:
    """``(source, id, size, row, copy)``: ``copy`` numbers, from 0, the rows of one source, id and size."""
    same = ["source", "id", "size"]
    local = F.row_number().over(Window.partitionBy("part", *same).orderBy("row")) - 1
    counts = sized.groupBy(*same, "part").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy(*same).orderBy("part")  # at most as many rows as input partitions
    counts = counts.select("part", *same, F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before")).where(F.col("before").isNotNull())
    # only rows that lie in several partitions have anything before them
    joined = sized.withColumn("local", local).alias("l").join(counts.alias("r"), (F.col("l.part") == F.col("r.part")) & F.expr(" and ".join(f"l.{c} <=> r.{c}" for c in same)), "left")
    return joined.select("l.source", "l.id", "l.size", "l.row", (F.col("local") + F.coalesce("before", F.lit(0))).alias("copy"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, seed: int = 7) -> DataFrame:
    """``(id, size, source_size, target, copies, taken)`` of each row, and ``row_col``, a unique row key, if it is given."""
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), row.alias("row"), F.spark_partition_id().alias("part"))
    sized = materialise(sized, "sizes")
    sized = materialise(_numbered(sized).withColumn("draw", F.xxhash64(F.lit(seed), F.col("id"), F.col("size"), F.col("copy"))), "draws")
    targets = source_targets(sized, weights, cap).withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    ratio = F.when(F.abs(ratio - F.rint(ratio)) < 1e-9, F.rint(ratio)).otherwise(ratio)
    wanted = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        "id", F.col("row").alias("key"), "source", "size", "draw", "source_size", "target", F.floor(ratio).alias("base"), (ratio - F.floor(ratio)).alias("p")
    )
    kinds = ["source", "class"]
    fractional = (F.col("p") > 0) & (F.col("size") > 0)
    certain = wanted.where(~fractional).select("id", "key", "size", "source_size", "target", F.col("base").alias("copies"))
    shares = wanted.where(fractional).withColumn("class", F.floor(F.log2("size") * 4).cast("int"))
    count = shares.groupBy(*kinds).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    shares = shares.join(count.withColumnsRenamed({"source": "s", "class": "c"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")))
    # what a document needs at the end rides along in "row"
    facts = F.struct("id", "key", "source_size", "target", "base")
    units = shares.select(*kinds, F.pmod("draw", "blocks").alias("b"), "blocks", "size", "draw", facts.alias("row"), "p")
    rounded = []
    keys, carried = [*kinds, "b"], ["blocks"]
    while True:
        level = materialise(_fold(units, keys, carried), "pivot")
        still = (F.col("p") > 0) & (F.col("p") < 1)
        top = not carried and keys == ["source"]
        rounded.append(level.select("row", "size", F.when(still, F.rint("p")).otherwise(F.col("p")).alias("p")) if top else level.where(~still).select("row", "size", "p"))
        if top:
            break
        units = level.where(still)
        if (units.agg(F.max("blocks")).first()[0] or 0) > 1:
            units = units.withColumns({"b": F.floor(F.col("b") / block), "blocks": F.ceil(F.col("blocks") / block)})
        else:  # one residual of each class of sizes is left
            keys, carried = ["source"], []
    chosen = rounded[0]
    for r in rounded[1:]:
        chosen = chosen.unionByName(r)
    chosen = chosen.select("row.id", "row.key", "size", "row.source_size", "row.target", (F.col("row.base") + F.col("p").cast("long")).alias("copies"))
    out = certain.unionByName(chosen)
    key = [F.col("key").alias(row_col)] if row_col else []
    return out.select(F.col("id").alias(id_col), *key, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))

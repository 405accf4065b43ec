"""Operator 9, sharding by a hierarchical weighted hash tree.

A topology is regions of racks of shards with weights. A document descends from
the root: at each level every child of the node reached draws an exponential
variate of its summed weight, -ln(u) / weight, from a hash of the id and the
child's place in the tree, and the least draw wins. A level costs as many hashes as
its widest node has children; the number of shards doesn't count.

Draws of children whose weight stays are the same in another topology. So if a
weight grows, documents move only into the child that holds it, level by level, and
if it shrinks, only out of that child; what stays in other regions and racks
keeps its shard. A shard that is added as a region of its own takes documents
only into itself: that is how ``grown_shard`` is made.

Slots are gapless from 0 in each shard: rows are range-sorted by shard, id and row,
so that even copies of one id are spread over tasks, counted within each range,
and the ranges' counts are summed up before.

Defined cases: a null text has size 8 and CRC 0; a null id hashes as no value
and lies in one shard like any other id; very long texts only lend size and CRC;
repeated rows share the shard and get slots of their own; ties between draws go to the
first child; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalspark.llm.common import map_batches, materialise, type_of

Topology = list[list[list[float]]]

#: 24 equal shards: 2 regions of 3 racks of 4 shards. One more shard is a region of its own.
SHARDS_24: Topology = [[[1.0] * 4] * 3] * 2
SHARDS_25: Topology = [*SHARDS_24, [[1.0]]]


def _descend(key: Column, level: str, path: list[Column], weights: list[list[float]], node: Column, seed: int) -> Column:
    """Child of ``node`` (an index into ``weights``) whose draw is least."""
    wide = max(map(len, weights))
    table = F.array(*(F.array(*(F.lit(float(w)) for w in [*ws, *[0.0] * (wide - len(ws))])) for ws in weights))
    own = F.element_at(table, node + 1) if len(weights) > 1 else table[0]
    draws = []
    for i in range(wide):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), *path, F.lit(i), key), 11) + F.lit(0.5)) / float(1 << 53)
        weight = F.element_at(own, F.lit(i + 1))
        draws.append(F.struct(F.when(weight > 0, -F.ln(u) / weight).otherwise(F.lit(float("inf"))).alias("draw"), F.lit(i).alias("at")))
    return F.array_min(F.array(*draws))["at"]


def shard_of(docs: DataFrame, key_col: str, topology: Topology, name: str = "shard", seed: int = 11) -> DataFrame:
    """``docs`` with a column ``name``; shards are numbered along the topology."""
    key = F.col(key_col)
    racks = [rack for region in topology for rack in region]
    first_rack = np.cumsum([0, *map(len, topology)]).tolist()
    first_shard = np.cumsum([0, *map(len, racks)]).tolist()
    at = lambda starts, index: F.element_at(F.array(*map(F.lit, starts)), index + 1)
    df = docs.withColumn("_region", _descend(key, "region", [], [[sum(map(sum, region)) for region in topology]], F.lit(0), seed))
    region = F.col("_region")
    df = df.withColumn("_rack", _descend(key, "rack", [region], [[sum(rack) for rack in region_] for region_ in topology], region, seed))
    rack = at(first_rack, region) + F.col("_rack")
    df = df.withColumn("_shard", _descend(key, "shard", [region, F.col("_rack")], racks, rack, seed))
    return df.withColumn(name, at(first_shard, rack) + F.col("_shard")).drop("_region", "_rack", "_shard")


def _with_slots(facts: DataFrame) -> DataFrame:
    """``facts`` with a gapless ``slot`` in each shard, in the order of id, text and row."""
    order = ["shard", "id", "text_crc32", "size", "row"]
    spark = facts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["part", "shard", "id", "size", "text_crc32", "grown_shard"]

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last, n = None, 0  # shard and rows of it so far
        for b in batches:
            shard = b.column(1).to_numpy()
            if not len(shard):
                continue
            new = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1 if last is None else last))
            place = np.arange(len(shard)) + n
            if len(new):
                start = np.zeros(len(shard), np.int64)
                start[new] = place[new]
                start = np.maximum.accumulate(start)
                place = place - start
            last, n = int(shard[-1]), int(place[-1]) + 1
            yield {name: b.column(i) for i, name in enumerate(columns)} | {"place": place}

    ordered = facts.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kind = type_of(facts, "id")
    placed = materialise(map_batches(ordered.select(*columns), running, f"part int, shard int, id {kind}, size long, text_crc32 long, grown_shard int, place long"), "places")
    # each range holds a few shards: about as many rows as ranges and shards together
    count = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(count), ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("place")).cast("long"))


def shard_documents(docs: DataFrame, topology: Topology = SHARDS_24, grown: Topology = SHARDS_25, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` of each row."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    facts = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    facts = materialise(facts, "shards")  # the range sort samples its input: texts are read once
    facts = _with_slots(shard_of(shard_of(facts, "id", topology, "shard", seed), "id", grown, "grown_shard", seed))
    return facts.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

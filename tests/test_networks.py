"""Distances along networks against Dijkstra's algorithm, and the number of rounds on long chains."""

import heapq
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalspark.operators import profiles


def dijkstra(edges, roots):
    near = defaultdict(list)
    for a, b, m in edges:
        near[a].append((b, m))
        near[b].append((a, m))
    done, queue = {}, [(0.0, r) for r in roots]
    while queue:
        d, n = heapq.heappop(queue)
        if n not in done:
            done[n] = d
            for b, m in near[n]:
                heapq.heappush(queue, (d + m, b))
    return done


def network(kind, rng):
    if kind == "tree":
        return [(int(rng.integers(0, i)), i, float(rng.integers(1, 9))) for i in range(1, 120)]
    if kind == "caterpillar":
        return [(i, i + 1, 1.0) for i in range(60)] + [(i, 1000 + i, 2.0) for i in range(60)]
    if kind == "loops":  # rings on a stem, parallel edges, an edge to itself, a ring alone
        rings = [(100 * k + i, 100 * k + (i + 1) % 7, float(1 + i)) for k in range(5) for i in range(7)]
        return [*rings, *((100 * k, 100 * (k + 1) + 3, 2.0) for k in range(3)), (0, 1, 0.25), (0, 100, 50.0), (5, 5, 1.0)]
    return [(int(a), int(b), float(rng.integers(1, 20))) for a, b in rng.integers(0, 60, (110, 2))]


@pytest.mark.parametrize("kind", ["tree", "caterpillar", "loops", "mesh"])
def test_stations_equal_dijkstra(spark, kind):
    rng = np.random.default_rng(4)
    edges = network(kind, rng)
    frame = spark.createDataFrame(edges, "from_node long, to_node long, length_m double")
    labels = profiles.components(frame).cache()
    ids = sorted({n for a, b, _ in edges for n in (a, b)})
    y = {n: float(rng.integers(0, 50)) for n in ids}
    got = {r["node"]: r["s_m"] for r in profiles.stationed(frame, labels, spark.createDataFrame(list(y.items()), "node long, y double")).collect()}
    degree, members = defaultdict(int), defaultdict(list)
    for a, b, _ in edges:
        degree[a] += 1
        degree[b] += 1
    for r in labels.collect():
        members[r["component_id"]].append(r["node"])
    roots = [min(m, key=lambda n: (degree[n] != 1, y[n], n)) for m in members.values()]
    assert got == pytest.approx(dijkstra(edges, roots)) and set(got) == set(ids)


def test_a_long_chain_takes_rounds_that_grow_with_its_logarithm(spark, monkeypatch):
    n, written = 5000, []
    inner = profiles.checkpointed
    monkeypatch.setattr(profiles, "checkpointed", lambda df: written.append(1) or inner(df))
    edges = spark.range(n).select(F.col("id").alias("from_node"), (F.col("id") + 1).alias("to_node"), F.lit(2.0).alias("length_m"))
    nodes = spark.range(n + 1).select(F.col("id").alias("node"), F.col("id").cast("double").alias("y"))
    labels = nodes.select("node", F.lit(0).cast("long").alias("component_id"))
    got = profiles.stationed(edges, labels, nodes).where("s_m = 2.0 * node").count()
    assert got == n + 1 and len(written) < 45

"""Operator 10, near-duplicates: SimHash fingerprints linked by multi-index hashing.

1. ``fingerprints``: the 64-bit majority of the XXH64 hashes of a text's word
   shingles, repeats included. Documents, not texts, go to the shared folder.
2. ``links``: distinct fingerprints are cut into three segments (two, if there are very many). Two that differ
   in at most ``distance`` bits differ in at most ``distance // 3`` of some segment, so
   each puts its segments into a table and looks up, there, the ball of that radius
   (1 for 4 bits) about them. As one direction is enough, the ball is halved: of
   two values the look-up goes from the one with fewer ones, or, of as many, from both.
   Matches are verified on all 64 bits. Segment values that very many
   fingerprints share are cut again by the other bits, with an index of their own. A task gives back a forest of what
   it has linked, not all pairs. Balls of radius 2 hold about 120 values a segment and
   of radius 3 about 900; larger ones (``distance`` of 12 and more) raise an error.
3. ``connected_components``: large-star and small-star rounds over the forest. What
   a round joins by a hub is written first, so that both sides of the join are plain
   shuffles, which adaptive execution splits where one hub has most of the rows.

Copies of a text share one fingerprint and never pair with each other.

Defined cases: very long texts are hashed whole; texts without a word (null, empty) have fingerprint 0 and are
linked like any other; texts shorter than a shingle are one shingle; a null id
is never the smallest, and a component of null ids alone has a null id; repeated
rows are one group; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.llm.common import free_names, map_batches, materialise, row_hash, type_of, utf8

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (first bit, bits) of each segment, up to so many distinct fingerprints (32 a value on average) and beyond.
SEGMENTS, FEW_FINGERPRINTS, LONG_SEGMENTS = ((0, 21), (21, 21), (42, 22)), 1 << 26, ((0, 32), (32, 32))
#: Balls beyond this radius hold too many values to enumerate.
MAX_RADIUS = 3
#: Table rows of a segment value beyond which it is cut by the other bits.
HOT = 4096
_PAIRS, _HELD = 2_000_000, 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = utf8(text).lower().split()  # bytes: only A-Z are lowered, and only space and \t to \r split
    if not words:
        return 0
    line = b" ".join(words)
    k = min(shingle, len(words))
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    begin = [0, *(end[: len(words) - k] + 1).tolist()]
    digest, ones, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(words) - k + 1
    stop = end[k - 1 :].tolist()
    for at in range(0, n, 8192):
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(begin[at : at + 8192], stop[at : at + 8192], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, **carried: Column) -> DataFrame:
    """``(id, fp)`` and the ``carried`` whole numbers: fingerprints as signed 64-bit numbers."""

    names = list(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield {"id": b.column(0), "fp": fp} | {name: b.column(2 + i) for i, name in enumerate(names)}

    schema = ", ".join([f"id {type_of(docs, id_col)}", *(f"`{name}` long" for name in ("fp", *names))])
    return materialise(map_batches(docs.select(F.col(id_col), text_col, *(c.alias(name) for name, c in carried.items())), run, schema), "fingerprints")


def layout(n: int, distance: int = DISTANCE) -> tuple[tuple[int, int], ...]:
    """Segments for ``n`` distinct fingerprints: three, or two longer ones where three would put too many under one value and their balls can be enumerated."""
    return LONG_SEGMENTS if n > FEW_FINGERPRINTS and distance // len(LONG_SEGMENTS) <= MAX_RADIUS else SEGMENTS


def _balls(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)]


def _key(s: int) -> int:
    """Keys are a segment's value, its number above bit 34, and for cut values a part's number above bit 36 and its value above bit 38."""
    return s << 34


def segment_rows(distinct: DataFrame, distance: int = DISTANCE, segments: tuple[tuple[int, int], ...] = SEGMENTS) -> DataFrame:
    """``(key, probe, fp)``: each fingerprint's table rows and its look-ups."""
    radius = distance // len(segments)
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"distance must be from 0 to {len(segments) * (MAX_RADIUS + 1) - 1}")
    found = []
    for s, (first, bits) in enumerate(segments):
        value = f"(shiftrightunsigned(fp, {first}) & {(1 << bits) - 1}L)"
        ball = F.explode(F.array(*(F.lit(m).cast("long") for m in _balls(bits, radius)))).alias("mask")
        rows = distinct.select("fp", F.expr(value).alias("value"), ball).withColumn("probed", F.col("value").bitwiseXOR(F.col("mask")))
        rows = rows.where(F.bit_count("probed") >= F.bit_count("value"))
        found.append(rows.select((F.lit(_key(s)) + F.col("probed")).alias("key"), F.lit(True).alias("probe"), "fp"))
        found.append(distinct.select(F.expr(f"{_key(s)}L + {value}").alias("key"), F.lit(False).alias("probe"), "fp"))
    return functools.reduce(DataFrame.unionByName, found)


def _cut_again(rows: DataFrame, distinct: DataFrame, distance: int, segments: tuple[tuple[int, int], ...], hot: int) -> DataFrame:
    """Hot segment values become tables of their own: the fingerprints' other bits in three parts, one of which differs in ``distance // 3`` bits at most.

    A table row goes to one key a part and a look-up to the ball about each, so that the rows of
    a hot value neither all meet nor are copied.
    """
    table = F.array(*(F.expr(f"{_key(s)}L + (shiftrightunsigned(fp, {first}) & {(1 << bits) - 1}L)") for s, (first, bits) in enumerate(segments)))
    counts = distinct.select(F.explode(table).alias("key")).groupBy("key").count()
    heavy = materialise(counts.where(F.col("count") > hot).select("key"), "hot-values")
    n = heavy.count()
    if not n:
        return rows
    cut = rows.join((F.broadcast(heavy) if n <= 10_000 else heavy).withColumn("is_hot", F.lit(True)), "key", "left")
    kept = cut.where(F.col("is_hot").isNull()).drop("is_hot")
    found = [kept.select("key", "probe", "fp")]
    for s, (first, bits) in enumerate(segments):
        above = "0L" if first + bits == 64 else f"shiftleft(shiftrightunsigned(fp, {first + bits}), {first})"
        rest = F.expr(f"(fp & {(1 << first) - 1}L) | {above}")
        of = cut.where(F.col("is_hot") & (F.shiftright("key", 34) == s)).withColumn("rest", rest)
        left = 64 - bits
        cuts = [left * i // 3 for i in range(4)]
        asked, held = [], []
        for j, (a, b) in enumerate(itertools.pairwise(cuts)):
            part = F.shiftrightunsigned("rest", a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
            at = lambda v, j=j: F.col("key") + F.lit((j + 1) << 36) + F.shiftleft(v, 38)
            held.append(at(part))
            asked += [at(part.bitwiseXOR(F.lit(m).cast("long"))) for m in _balls(b - a, min(distance // 3, b - a))]
        for probe, keys in ((False, held), (True, asked)):
            found.append(of.where(F.col("probe") == probe).select(F.explode(F.array(*keys)).alias("key"), "probe", "fp"))
    return functools.reduce(DataFrame.unionByName, found)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, root)`` of the nodes of edges (a, b) that aren't their component's least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def links(distinct: DataFrame, distance: int = DISTANCE, hot: int = HOT, segments: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """``(a, b)``, a spanning forest per task of the links between distinct fingerprints; ``segments`` follow their number where not given."""
    segments = segments or layout(distinct.count(), distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)  # table rows of the last key so far
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = limit = 0
        limit = _HELD
        for batch in batches:
            k, probe, f = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            key, fp = np.concatenate([key, k[~probe]]), np.concatenate([fp, f[~probe]])
            pk, pf = k[probe], f[probe]
            lo = np.searchsorted(key, pk, "left")
            count = np.searchsorted(key, pk, "right") - lo
            some = count > 0
            lo, count, pf = lo[some], count[some], pf[some]
            cut = np.searchsorted(np.cumsum(count), np.arange(_PAIRS, count.sum() + _PAIRS, _PAIRS), "right") if len(count) else []
            for i, j in zip([0, *cut], [*cut, len(count)], strict=True):
                if i == j:
                    continue
                c = count[i:j]
                left = np.repeat(pf[i:j], c)
                right = fp[np.repeat(lo[i:j] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
                near = (left != right) & (np.bitwise_count((left ^ right).view(np.uint64)) <= distance)
                if near.any():
                    held.append((left[near], right[near]))
                    n_held += int(near.sum())
                if n_held > limit:
                    held = [forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))]
                    n_held = len(held[0][0])
                    limit = _HELD + n_held
            last = key == k[-1] if len(k) else np.zeros(len(key), bool)
            key, fp = key[last], fp[last]
        if held:
            a, b = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            yield {"a": a, "b": b}

    rows = _cut_again(segment_rows(distinct, distance, segments), distinct, distance, segments, hot)
    return map_batches(rows.repartition("key").sortWithinPartitions("key", "probe"), run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of the nodes of edges (a, b) but for the roots, the least nodes."""
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        # large star: every larger neighbour of a node goes to the node's least neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = materialise(large, "large")
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` of each row."""
    found = fingerprints(docs, id_col, text_col, shingle)
    classes = materialise(found.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = connected_components(links(classes.select("fp"), distance))
    rooted = materialise(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    component = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component")
    by_fp = rooted.join(component, "root").select("fp", "component_id")
    named = found.join(by_fp, "fp")
    return named.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each component: the least by id (nulls last), text hash and row hash; extra columns may have any name and type."""
    text_hash, whole_hash, kept_id, kept_text, kept_row = free_names(docs, "text_hash", "row_hash", "kept_id", "kept_text", "kept_row")
    hashed = docs.withColumns({text_hash: F.xxhash64(text_col), whole_hash: row_hash(docs)})
    hashes = {"of_text": F.col(text_hash), "of_row": F.col(whole_hash)}
    found = fingerprints(hashed, id_col, text_col, shingle, **hashes)
    key = F.struct(F.col("id").isNull().alias("last"), "id", "of_text", "of_row")
    classes = materialise(found.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    roots = connected_components(links(classes.select("fp"), distance))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("least", F.coalesce("root", "fp").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("least").alias("least"))
    stay = stay.select(F.col("least.id").alias(kept_id), F.col("least.of_text").alias(kept_text), F.col("least.of_row").alias(kept_row))
    same = F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(text_hash) == F.col(kept_text)) & (F.col(whole_hash) == F.col(kept_row))
    # rows of one key are equal in all columns, so any of them may stay
    return hashed.join(stay, same, "left_semi").dropDuplicates([id_col, text_hash, whole_hash]).drop(text_hash, whole_hash)

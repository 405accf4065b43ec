"""Operator 12, importance resampling towards a target set, ranked by a radix sort.

1. ``bucket_counts``: hashed runs of one to three words, counted over all texts of the
   corpus and of the target; each task adds up one array of ``buckets`` counts.
2. ``gains``: the log ratio of each bucket's shares, in thousandths, on the driver
   (``buckets`` numbers).
3. ``score``: each text's weight is the sum of its runs' gains; a Gumbel draw from the id's hash
   makes the score, so that the highest scores are a draw without replacement.
4. ``radix_ranks``: least-significant-digit radix sort. In each pass rows are counted by
   (digit, chunk of positions); sums over smaller digits, and over earlier chunks of
   the same digit, are the chunk's first destination; a row's place among its
   chunk's rows of that digit is added. Passes are stable and go from the id's lowest
   digit to the score's highest, so final positions are final ranks. A chunk
   is bounded, so a digit that has most of the rows is still many groups.
   Rows whose highest score digit is below that of the last drawn one leave before the passes.

Narrow rows (ids, scores) go through the passes and the shared folder, never texts.

Defined cases: null and empty texts have no runs and weight 0; very long texts are
taken whole; a null id draws as an empty one and comes after all others of its score; ids are whole
numbers of any range; repeated rows are ranked each for themselves; ties go to the smaller id,
then to the row's place in the scan; extra columns are ignored; with an empty target all shares come
from the corpus; an empty table gives no row.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalspark.llm.common import map_batches, materialise, type_of, utf8

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 5, 20, 42
#: Bits of a digit, and chunks of positions whose digits are counted apart.
DIGIT_BITS, CHUNKS = 12, 1024

_KEPT = set(string.digits.encode() + string.ascii_lowercase.encode()) | set(range(128, 256))
_FOLD = bytes(c if c in _KEPT else 32 for c in bytes(range(256)).lower())


def runs(text: str | None) -> tuple[int, list[int]]:
    """Words of ``text`` and the crc32 of each run of one to three of them."""
    words = utf8(text).translate(_FOLD).split()
    after = list(map(b" ".__add__, words))
    one = list(map(zlib.crc32, words))
    two = list(map(zlib.crc32, after[1:], one))  # a run's checksum goes on from the run before it
    three = list(map(zlib.crc32, after[2:], two))
    return len(words), one + two + three


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> dict[int, int]:
    """Runs of all texts by bucket: at most ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                found = runs(text.as_py())[1]
                seen += np.bincount(np.array(found, np.int64) % buckets, minlength=buckets)
        some = np.flatnonzero(seen)
        yield {"bucket": some, "n": seen[some]}

    counted = map_batches(texts.select(text_col), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in counted.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain: 1000 times the log of its share of the target by its share of the corpus, each count plus one, floored."""
    all_corpus, all_target = float(sum(corpus.values())), float(sum(target.values()))
    ratio = ((target.get(i, 0) + 1.0) * (all_corpus + buckets) / ((corpus.get(i, 0) + 1.0) * (all_target + buckets)) for i in range(buckets))
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratio], np.int64)


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """A draw from the Gumbel distribution by the id's hash, in thousandths, floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``(row, id, n_words, n_features, weight, score)`` of each row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            words, features, weight = [], [], []
            for text in b.column(2):  # one text's runs at a time
                n, found = runs(text.as_py())
                words.append(n)
                features.append(len(found))
                weight.append(int(gain[np.array(found, np.int64) % buckets].sum()))
            yield {"row": b.column(0), "id": b.column(1), "n_words": words, "n_features": features, "weight": weight}

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    weighed = map_batches(rows, run, f"row long, id {type_of(docs, id_col)}, n_words long, n_features long, weight long")
    return materialise(weighed.withColumn("score", F.col("weight") + gumbel("id", seed)), "scores")


def _digits(column: str, least: int | None, most: int | None, bits: int, falling: bool = False) -> list[Column]:
    """Digits of a whole number, lowest first, as many as its range has; they order like the number."""
    if least is None or least == most:
        return []
    x = F.coalesce(F.col(column), F.lit(0)).cast("long").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    x = F.bitwise_not(x) if falling else x
    width = ((least ^ most) & ((1 << 64) - 1)).bit_length()  # higher bits are the same in all rows
    cuts = range(0, width, bits)
    return [F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << min(bits, width - at)) - 1).cast("long")) for at in cuts]


def counting_pass(state: DataFrame, digit: Column, chunk: Column) -> DataFrame:
    """``state`` with ``pos`` in the stable order of ``digit``; ``chunk`` grows with the former ``pos``."""
    keyed = state.withColumn("digit", digit).withColumn("chunk", chunk)
    counts = keyed.groupBy("digit", "chunk").count()
    totals = counts.groupBy("digit").agg(F.sum("count").alias("total"))  # at most 2 ** digit_bits rows, so one window holds them
    before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("digit", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    earlier = F.coalesce(F.sum("count").over(Window.partitionBy("digit").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("earlier", earlier).join(F.broadcast(base), "digit").select("digit", "chunk", (F.col("base") + F.col("earlier")).alias("begin"))
    place = F.row_number().over(Window.partitionBy("digit", "chunk").orderBy("pos")) - 1
    moved = keyed.withColumn("place", place).join(offsets, ["digit", "chunk"]).withColumn("pos", F.col("begin") + F.col("place"))
    return materialise(moved.select(state.columns), "radix")


def radix_ranks(rows: DataFrame, k: int, digit_bits: int = DIGIT_BITS, chunks: int = CHUNKS) -> DataFrame:
    """``(row, rank)`` of the ``k`` rows of highest score, ties to the smaller id; ``rows`` has ``row, id, score``."""
    if k < 1:
        return rows.sparkSession.createDataFrame([], "row long, rank long")
    of = rows.agg(*(f(c) for c in ("id", "score") for f in (F.min, F.max)), F.max(F.col("id").isNull().cast("int"))).first()
    by_score = _digits("score", of[2], of[3], digit_bits, falling=True)
    if by_score:  # rows of a later highest digit than the k-th row's can't be drawn
        before, last = 0, None
        for last, n in sorted(rows.groupBy(by_score[-1].alias("digit")).count().collect()):  # at most 2 ** digit_bits rows
            before += n
            if before >= k:
                break
        rows = rows.where(by_score[-1] <= last)
    digits = _digits("id", of[0], of[1], digit_bits) + ([F.col("id").isNull().cast("long")] if of[4] else []) + by_score
    # a scan's row ids hold the partition above 33 bits: ordered, and a chunk a partition, but not dense before the first pass
    state = materialise(rows.select("row", "id", "score", F.col("row").alias("pos")), "drawn")
    chunk, size = F.shiftrightunsigned("pos", 33), -(-state.count() // chunks)
    for digit in digits or [F.lit(0).cast("long")]:
        state = counting_pass(state, digit, chunk)
        chunk = F.floor(F.col("pos") / size).cast("long")
    return state.where(F.col("pos") < k).select("row", (F.col("pos") + 1).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", digit_bits: int = DIGIT_BITS, chunks: int = CHUNKS,
) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` of each row; ``share`` percent of the texts with ``least_words`` words are drawn, the others' rank is null."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets), buckets)
    scored = score(docs, gain, id_col, text_col, seed)
    long_enough = scored.where(F.col("n_words") >= least_words)
    ranks = radix_ranks(long_enough, share * long_enough.count() // 100, digit_bits, chunks)
    return scored.join(ranks, "row", "left").select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")

"""Operator 6, packing along a space-filling curve.

1. ``tokenize``: ids of whole texts (uint16 or uint32 bytes) and a Hilbert key:
   hashed token frequencies, scaled to unit length and projected by fixed signs
   to four dimensions. The table goes to the shared folder.
2. ``curve_offsets``: only (row, key, length) are range-sorted by (key, row); sums
   within partitions, then the partitions' sums, give each document its offset
   in the one long stream along the curve.
3. ``pack``: each document is cut where its part of the stream crosses a multiple
   of the sequence length. All sequences are full but for the last.

Texts are split, before the tokenizer, at single spaces between two non-blanks,
where its pre-tokens end anyway; known chunks' ids are remembered by process.

Defined cases: null and empty texts are one end id; very long texts span as many
sequences as they need; ties in the key are ordered
by the row's place in the scan; repeated rows are packed each for themselves;
an empty table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.llm.common import map_batches, materialise, type_of
from shoalspark.llm.tokens import _loaded, load_tokenizer

#: Chunks whose ids a process remembers at most, and their longest.
MAX_CACHE, LONGEST_KEPT = 700_000, 64
BUCKETS, DIMENSIONS, BITS = 1024, 4, 12

#: White space that is neither a space nor a line's end.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_JOINT = re.compile(r"(?<=\S) (?=\S)")


def chunks(text: str) -> list[str]:
    """Parts of ``text`` between which no pre-token runs.

    All but the first follow a space, or start with the line's end that parts
    them from the one before.
    """
    if not text:
        return []
    parts = text.replace("\n", " \n").split(" ")
    if "" in parts or "\n" in parts or _OTHER_SPACE.search(text):  # blanks that don't stand alone
        return _JOINT.split(text)
    return parts


class _Ids(dict):
    """Ids, as bytes, of chunks after ``lead``, found when first asked for."""

    def __init__(self, encode, lead: str) -> None:
        self.encode, self.lead = encode, lead

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk if chunk[:1] == "\n" else self.lead + chunk)
        if len(chunk) <= LONGEST_KEPT:
            self[chunk] = ids
        return ids


class IdCache:
    """Ids of texts by way of their chunks' ids.

    Chunks of letters alone are merged by tiktoken over the tokenizer file's own
    vocabulary, which gives the same ids if ids follow the order of the merges
    (tested when loaded); all others, and special tokens, by tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.merge = _merger(path)
        self.code = "H" if self.kind == np.uint16 else "I"
        self.first, self.rest, self.tail = _Ids(self._encode, ""), _Ids(self._encode, " "), _Ids(self._encode, "")

    def _encode(self, chunk: str) -> bytes:
        core = chunk.rstrip(".,;:!?")  # marks after letters are a pre-token of their own
        if self.merge and core[1:].isalpha() and (core[0] == " " or core[0].isalpha()):
            return array(self.code, self.merge(core)).tobytes() + (self.tail[chunk[len(core) :]] if core != chunk else b"")
        return array(self.code, self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """Ids of each text, then ``end_id``."""
        if len(self.rest) + len(self.first) > MAX_CACHE:
            self.first.clear()
            self.rest.clear()
        end, get, out = np.array([end_id], self.kind).tobytes(), self.rest.__getitem__, []
        for text in texts:
            parts = chunks(text)
            head = self.first[parts[0]] if parts else b""
            out.append(np.frombuffer(head + b"".join(map(get, parts[1:])) + end, self.kind))
        return out


def _merger(path: str):
    """Merges one pre-token, or None if the vocabulary's ids don't follow its merges."""
    if ("merge", path) not in _loaded:
        import tiktoken

        model = json.loads(load_tokenizer(path).to_str())["model"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        vocab = model["vocab"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if plain and len(vocab) == len(merges) + 256 and all(vocab.get(m) == 256 + i for i, m in enumerate(merges)):
            byte = _byte_letters()
            ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
            # a chunk of letters is one pre-token, so that any pattern that takes it whole will do
            _loaded["merge", path] = tiktoken.Encoding("chunks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            _loaded["merge", path] = None
    return _loaded["merge", path]


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: itself, or the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def projection() -> np.ndarray:
    """Fixed signs, from a multiplicative hash of bucket and dimension."""
    n = np.arange(1, BUCKETS * DIMENSIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    n ^= n >> np.uint64(29)
    n *= np.uint64(0xBF58476D1CE4E5B9)
    return np.where(n >> np.uint64(63), 1.0, -1.0).reshape(BUCKETS, DIMENSIONS)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of integer points (n, d), each in [0, 2**bits)."""
    x = points.astype(np.int64).T.copy()
    d, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations and reflections of each level
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip = np.where(x[d - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, key, n, ids)`` of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cache, signs = IdCache(tokenizer_path), projection()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = cache([t or "" for t in part.column(2).to_pylist()], end_id)
                seen = np.stack([np.bincount(x % BUCKETS, minlength=BUCKETS) for x in ids]).astype(np.float64)
                place = seen @ signs / np.linalg.norm(seen, axis=1)[:, None]
                grid = ((np.tanh(place) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
                yield {"row": part.column(0), "id": part.column(1), "key": hilbert_key(grid), "n": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]}

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialise(map_batches(rows, run, f"row long, id {type_of(docs, id_col)}, key long, n long, ids binary"), "ids")


def curve_offsets(tokens: DataFrame) -> DataFrame:
    """``(row, begin)``: ids before each row in the order of (key, row)."""
    spark = tokens.sparkSession

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = 0
        for b in batches:
            n = b.column(2).to_numpy()
            yield {"part": b.column(0), "row": b.column(1), "local": total + np.cumsum(n) - n, "n": n}
            total += int(n.sum())

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.select("row", "key", "n").repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
    local = materialise(map_batches(ordered.select(F.spark_partition_id().alias("part"), "row", "n"), running, "part int, row long, local long, n long"), "offsets")
    before, total = {}, 0
    for part, n in sorted(local.groupBy("part").agg(F.sum("n")).collect()):  # as many rows as partitions
        before[part], total = total, total + n
    if not before:
        return local.select("row", F.col("local").alias("begin"))
    base = spark.createDataFrame(list(before.items()), "part int, base long")
    return local.join(F.broadcast(base), "part").select("row", (F.col("base") + F.col("local")).alias("begin"))


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``."""
    tokens = tokenize(docs, tokenizer_path, end_id, id_col, text_col)
    kind = IdCache(tokenizer_path).kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out: list[tuple] = []
            for doc, begin, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(raw, kind).astype("<u4")
                at = 0
                while at < len(ids):
                    seq, offset = divmod(begin + at, length)
                    n = min(length - offset, len(ids) - at)
                    out.append((doc, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), seq, offset))
                    at += n
            names = (id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            yield {name: [r[i] for r in out] for i, name in enumerate(names)}

    placed = tokens.select("row", "id", "ids").join(curve_offsets(tokens), "row").select("id", "begin", "ids")
    return map_batches(placed, run, f"`{id_col}` {type_of(docs, id_col)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

"""Operator 1, media columns: payloads as PNG images in a binary column, with perceptual hashes.

``encode_media`` writes each payload as an 8-bit grey PNG, 64 samples a row:
rows are filtered (none, sub or up, by the least sum of absolute values),
deflated and split into IDAT chunks, each with its CRC. ``decode_media`` reads
the stored bytes alone: it tests the signature and each chunk's CRC, inflates,
undoes any of the five filters with numpy and derives a 64-bit hash from the
low frequencies of a cosine transform.

Defined cases: a null or empty text is a payload of 64 zero bytes; a very long text is
one image of as many rows as it takes; equal texts, repeated rows among them, give equal
media; frequencies that tie with the median count as below it; damaged media give null
features and an ``error``; ids of any type, null too, pass through; columns
besides the id and the text are ignored; row count and order stay; an empty table
gives no row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.llm.common import map_batches, type_of, utf8

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
CHUNK = 1 << 20


def pad(payload: bytes, width: int = WIDTH) -> bytes:
    """Zero bytes up to a positive multiple of ``width``."""
    return payload.ljust(max(1, -(-len(payload) // width)) * width, b"\0")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, width: int = WIDTH, level: int = 3) -> bytes:
    """Lossless PNG of a payload whose length is a positive multiple of ``width``."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = image.copy(), image.copy()
    sub[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (image, sub, up)])
    kind = cost.argmin(axis=0).astype(np.uint8)
    rows = np.empty((len(image), width + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = np.where((kind == 0)[:, None], image, np.where((kind == 1)[:, None], sub, up))
    data = zlib.compress(rows.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo PNG filters 0 to 4 of ``rows`` (filter byte first, one byte a pixel)."""
    kind, out = rows[:, 0], rows[:, 1:].copy()
    if kind.max(initial=0) > 4:
        raise ValueError("unknown filter")
    sub = kind == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    if (kind > 2).any():
        _unfilter_in_order(kind, out)
        return out
    up = kind == 2
    if up.any():  # a run of "up" rows is a running sum from the row before it
        up[0] = False
        total = np.cumsum(out, axis=0, dtype=np.uint8)
        first = np.maximum.accumulate(np.where(up, -1, np.arange(len(out))))
        before = np.vstack([np.zeros((1, out.shape[1]), np.uint8), total])[first]
        out = total - before
    return out


def _unfilter_in_order(kind: np.ndarray, out: np.ndarray) -> None:
    above = np.zeros(out.shape[1], np.uint8)
    for k, row in zip(kind, out, strict=True):
        if k == 2:
            row += above
        elif k > 2:
            left = corner = 0
            for i, b in enumerate(above.tolist()):
                if k == 3:
                    guess = (left + b) >> 1
                else:
                    p = left + b - corner
                    guess = min((left, b, corner), key=lambda v: abs(p - v))
                left, corner = (int(row[i]) + guess) & 255, b
                row[i] = left
        above = row


def from_png(png: bytes) -> np.ndarray:
    """Image of an 8-bit grey PNG; raises ValueError if a check fails."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, data = 8, None, []
    while True:
        if at + 12 > len(png):
            raise ValueError("truncated chunk")
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if len(body) != n or struct.unpack(">I", png[at + 8 + n : at + 12 + n] or b"\0" * 4)[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum in {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a plain 8-bit grey image")
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError("bad deflate stream") from e
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("wrong image size")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1))


def _cosines(n: int, low: int) -> np.ndarray:
    k, i = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n))


_BASIS = _cosines(32, 8)


def _shrink(image: np.ndarray, axis: int, n: int = 32) -> np.ndarray:
    """Means of ``n`` equal strips along ``axis``; rows repeat if there are fewer."""
    edge = np.arange(n + 1) * image.shape[axis] // n
    if image.shape[axis] < n:
        return image.take(edge[:-1], axis)
    shape = [1, 1]
    shape[axis] = n
    return np.add.reduceat(image, edge[:-1], axis) / np.diff(edge).reshape(shape)


def dct_hash(image: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies exceed their median."""
    small = _shrink(_shrink(image.astype(np.float64), 0), 1)
    low = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, level: int = 3) -> DataFrame:
    """``(id, n_bytes, media)``: each text's UTF-8 bytes, zero-padded, as a PNG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            raw = [utf8(t) for t in b.column(1).to_pylist()]
            yield {id_col: b.column(0), "n_bytes": [len(x) for x in raw], "media": [to_png(pad(x, width), width, level) for x in raw]}

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {type_of(docs, id_col)}, n_bytes long, media binary")


def _features(media: bytes | None) -> tuple:
    try:
        image = from_png(media or b"")
    except ValueError as e:
        return None, None, None, None, None, None, str(e)
    payload = image.tobytes()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), dct_hash(image), None


def decode_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Features of the stored bytes: payload size, SHA-256 and tail CRC, media size and SHA-256, hash, error."""
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = [_features(m) for m in b.column(2).to_pylist()]
            yield {id_col: b.column(0), "n_bytes": b.column(1)} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_batches(
        media.select(id_col, "n_bytes", "media"),
        run,
        f"`{id_col}` {type_of(media, id_col)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string",
    )

"""Operator 3, token counts: pieces are counted once per distinct pre-token.

1. ``pretoken_frequencies``: each partition normalises and splits its texts as
   the tokenizer does and keeps, per document, (local code, count) pairs, and
   per chunk of documents a dictionary code -> pre-token. Both go to one table
   in the shared folder.
2. ``piece_counts``: the dictionaries' rows meet by pre-token (a hash shuffle);
   each distinct pre-token runs through the BPE model once.
3. Lengths return to their chunk, whose documents join them (a cogroup by chunk,
   of bounded size) and sum count x pieces. No id lists are made.

Texts of plain letters, digits and ASCII marks are split by a regular expression
if, when the file is loaded, it splits a probe text of all these signs as the tokenizer
does (word_bpe_49k does, byte-level files don't); any other text, and any text
of another tokenizer, is split by the tokenizer's own normaliser and pre-tokenizer, so
that results are the library's for all.

Defined cases: very long texts are counted whole; null and empty texts have 0 tokens; a special token's string in a
text counts as that one token (the library's default); repeated rows count each
for themselves; ids may be null or repeat; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shoalspark.llm.common import map_batches, materialise, type_of, utf8

#: Distinct pre-tokens, or documents, after which a chunk is closed.
MAX_DICTIONARY, MAX_DOCUMENTS = 500_000, 20_000

_LETTERS = "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķĺļľŀłńņňŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž"
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿĀ-įıĴ-ķĹ-ňŊ-ž]*")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_loaded: dict = {}


def load_tokenizer(path: str):
    """The tokenizer of a file, once per process, without its thread pool."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _probes() -> list[str]:
    """Texts with each plain sign by itself, after a letter, before a digit, in runs and after a quote."""
    signs = [c for c in map(chr, range(0x180)) if _PLAIN.fullmatch(c)]
    return [f"it's {c} a{c}b 1{c}2 {c}{c}'{c} {c}'ll{c}" for c in signs] + ["".join(signs), "  ".join(signs), "I'VE we'd 'tis don''t 12a3 \n\n x", ""]


class _Codes(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        code = self[key] = len(self)
        return code


class PreTokenizer:
    """Pre-tokens of a text, and how many special tokens its strings make."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.plain = all(_SPLIT.findall(probe.lower()) == self.by_library(probe) for probe in _probes())

    def __call__(self, text: str) -> tuple[list[str], int]:
        if not (self.special and self.special.search(text)):
            return self.split(text), 0
        out: list[str] = []
        parts = self.special.split(text)
        for part in parts:
            out += self.split(part)
        return out, len(parts) - 1

    def split(self, text: str) -> list[str]:
        if self.plain and _PLAIN.fullmatch(text):
            return _SPLIT.findall(text.lower())
        return self.by_library(text)

    def by_library(self, text: str) -> list[str]:
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        if not self.tokenizer.pre_tokenizer:
            return [text] if text else []
        # offsets are those of characters in the normalised text
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def pretoken_frequencies(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Table of document rows (``pairs`` set) and dictionary rows (``piece`` set), by ``chunk``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cut = PreTokenizer(tokenizer_path)
        chunk, codes, held = uuid.uuid4().int >> 65, _Codes(), 0
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                pairs, base, sizes = [], [], []
                for t in part.column(1).to_pylist():
                    found, special = cut(t or "")
                    code = np.array(list(map(codes.__getitem__, found)), np.uint32)
                    uniq, count = np.unique(code, return_counts=True)
                    pairs.append(zlib.compress(np.diff(uniq, prepend=np.uint32(0)).astype("<u4").tobytes() + count.astype("<u4").tobytes(), 1))
                    base.append(special)
                    sizes.append(len(utf8(t)))
                n = part.num_rows
                yield {"chunk": [chunk] * n, "id": part.column(0), "n_bytes": sizes, "special": base, "pairs": pairs, "code": [None] * n, "piece": [None] * n}
                held += n
                if len(codes) >= MAX_DICTIONARY or held >= MAX_DOCUMENTS:
                    yield from entries(chunk, codes)
                    chunk, codes, held = uuid.uuid4().int >> 65, _Codes(), 0
        yield from entries(chunk, codes)

    def entries(chunk: int, codes: dict[str, int]) -> Iterator[dict]:
        words = list(codes)  # in the order of their codes
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            n = len(part)
            none = [None] * n
            yield {"chunk": [chunk] * n, "id": none, "n_bytes": none, "special": none, "pairs": none, "code": range(at, at + n), "piece": part}

    found = map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"chunk long, id {type_of(docs, id_col)}, n_bytes long, special int, pairs binary, code int, piece string")
    return materialise(found, "pretokens")


def piece_counts(frequencies: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(chunk, code, pieces)`` of the dictionary rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tokenizer = load_tokenizer(tokenizer_path)
        last, length = None, 0
        for b in batches:  # sorted by piece: equal ones are neighbours
            words = b.column(2).to_pylist()
            new = list(dict.fromkeys(words))
            known = dict(zip(new, map(len, tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True)) if new != [last] else {last: length}
            last = words[-1]
            length = known[last]
            yield {"chunk": b.column(0), "code": b.column(1), "pieces": [known[w] for w in words]}

    words = frequencies.where(F.col("piece").isNotNull()).select("chunk", "code", "piece")
    return map_batches(words.repartition("piece").sortWithinPartitions("piece"), run, "chunk long, code int, pieces int")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of each row."""
    frequencies = pretoken_frequencies(docs, tokenizer_path, id_col, text_col)
    kind = type_of(docs, id_col)
    schema = pa.schema([(id_col, to_arrow_type(frequencies.schema["id"].dataType)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def total(rows: pa.Table, entries: pa.Table) -> pa.Table:
        pieces = np.zeros(entries.num_rows, np.int64)
        pieces[entries["code"].to_numpy()] = entries["pieces"].to_numpy()
        out = []
        for special, pairs in zip(rows["special"].to_pylist(), rows["pairs"].to_pylist(), strict=True):
            raw = np.frombuffer(zlib.decompress(pairs), "<u4").astype(np.int64)
            code, count = np.cumsum(raw[: len(raw) // 2]), raw[len(raw) // 2 :]
            out.append(special + int(pieces[code] @ count))
        return pa.Table.from_arrays([rows["id"], rows["n_bytes"], pa.array(out, pa.int64()), pa.array([n > limit for n in out], pa.bool_())], schema=schema)

    rows = frequencies.where(F.col("pairs").isNotNull()).select("chunk", "id", "n_bytes", "special", "pairs")
    counts = piece_counts(frequencies, tokenizer_path)
    return rows.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(total, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

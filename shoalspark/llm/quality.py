"""Operator 2, quality rules: a short-circuit cascade ordered by rejection per cost.

A ``Text`` finds each statistic (words, symbols, repeated lines, repeated five-word
windows, letters) when a rule first asks for it and keeps it. The base's two rules
and the method's own are one cascade. ``fit_cascade`` times each rule, the statistics
it needs included, on texts of a random sample (about ``sample_rows`` rows, measured in
tasks; only one row a rule and task reaches the driver) and orders the rules by
rejections per second, half a rejection being added to each so that, of rules that
reject nothing in the sample, the cheaper comes first. Rules are priced alone: a
statistic that an earlier rule has found costs a later one less.
``keep_good`` applies the rules in that order and finds no statistic that it doesn't
need. ``quality_cascade`` returns the base's counts, too, and so finds those for every
row. The verdict, a conjunction, doesn't depend on the order.

Defined cases: a null text has no words and fails the base; very long texts are read
whole; ``\\n``-split lines without a word are no lines; ties in the order fall back to
the rules' names; an empty table keeps the declared order; repeated rows are judged
alike, and enter the sample each for themselves; extra columns are ignored, or kept by
``keep_good``.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.llm.common import filter_batches, map_batches, type_of, utf8

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LOWER = re.compile(r"[a-zß-öø-ÿ]")


class Text:
    """A text whose statistics are found when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return utf8(self.text).split()  # bytes split at exactly space and \t to \r

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in " \t\n\v\f\r")

    @cached_property
    def n_symbols(self) -> int:
        return len(_SYMBOLS.findall(self.text))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x and utf8(x).strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows of ``window`` words that occur twice or more (the first included)."""
    n, m = len(words), len(words) - window + 1
    if m < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    single, gram, size = code, code, 1
    while size < window:  # ranks of longer and longer windows stay below n, so that products fit
        step = min(size, window - size)
        right = (gram if step == size else single)[size:] if step in (size, 1) else None
        if right is None:
            step, right = 1, single[size:]
        _, gram = np.unique(gram[: len(right)] * np.int64(n + 1) + right, return_inverse=True)
        size += step
    hit = np.bincount(gram)[gram] > 1
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.flatnonzero(hit) + window, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def few_words(t: Text) -> bool:
    return len(t.words) < 10


def repetitive(t: Text) -> bool:
    return 100 * t.n_repeat_words > 20 * len(t.words)


def base_failed(t: Text) -> bool:
    return few_words(t) or repetitive(t)


def _lettered(t: Text) -> bool:
    return 2 * sum(1 for w in t.words if w.lower() != w.upper() or (not w.isascii() and any(c.isalpha() for c in w.decode("utf-8", "replace")))) >= len(t.words)


def _lower_case(t: Text) -> bool:
    upper = len(_UPPER.findall(t.text))
    return 10 * upper <= 3 * (upper + len(_LOWER.findall(t.text)))


Rules = dict[str, Callable[[Text], bool]]

#: What a text must hold to be kept, by name: the base's rules, and the method's own.
BASE: Rules = {"enough_words": lambda t: not few_words(t), "few_repeats": lambda t: not repetitive(t)}
RULES: Rules = {
    "symbols": lambda t: 10 * t.n_symbols <= len(t.words),
    "word_length": lambda t: 2 * len(t.words) <= t.word_chars <= 16 * len(t.words),
    "repeated_lines": lambda t: 2 * t.n_dup_lines <= len(t.lines),
    "lower_case": _lower_case,
    "letters": _lettered,
    "exclamations": lambda t: 4 * t.text.count("!") <= len(t.words),
}


def verdict(t: Text, order: list[str], rules: Rules) -> str | None:
    """The first rule in ``order`` that rejects the text, or None."""
    return next((r for r in order if not rules[r](t)), None)


def fit_cascade(docs: DataFrame, rules: Rules | None = None, sample_rows: int = 2000, text_col: str = "text", seed: int = 17) -> list[tuple[str, float, float]]:
    """``(rule, seconds a row, share rejected)`` of the base's rules and the given ones, best rejection per cost first."""
    every = BASE | (RULES if rules is None else rules)
    share = min(1.0, sample_rows / max(docs.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts = b.column(0).to_pylist()
            cost, lost = [], []
            for keep in every.values():
                fresh = [Text(t) for t in texts]  # each rule pays for its own statistics
                t0 = time.perf_counter()
                lost.append(sum(not keep(t) for t in fresh))
                cost.append(time.perf_counter() - t0)
            yield {"rule": list(every), "seconds": cost, "lost": lost, "rows": [len(texts)] * len(every)}

    sample = docs.select(text_col).sample(share, seed)
    got = map_batches(sample, run, "rule string, seconds double, lost long, rows long").groupBy("rule").agg(F.sum("seconds"), F.sum("lost"), F.sum("rows")).collect()
    seen = {r[0]: (r[1], r[2], max(r[3], 1)) for r in got}
    if not seen:
        return [(r, 0.0, 0.0) for r in every]
    gain = lambda r: (seen[r][1] + 0.5) / max(seen[r][0], 1e-9)
    return [(r, seen[r][0] / seen[r][2], seen[r][1] / seen[r][2]) for r in sorted(every, key=lambda r: (-gain(r), r))]


def quality_cascade(docs: DataFrame, order: list[str] | None = None, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of each row: ``kept``, and ``rejected_by`` (a rule, or null)."""
    every = BASE | (RULES if rules is None else rules)
    order = order or [r for r, _, _ in fit_cascade(docs, rules, text_col=text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts = [Text(t) for t in b.column(1).to_pylist()]
            why = [verdict(t, order, every) for t in texts]
            yield {
                id_col: b.column(0), "n_words": [len(t.words) for t in texts], "word_chars": [t.word_chars for t in texts], "n_symbols": [t.n_symbols for t in texts],
                "n_dup_lines": [t.n_dup_lines for t in texts], "n_repeat_words": [t.n_repeat_words for t in texts],
                "base_failed": [base_failed(t) for t in texts], "kept": [w is None for w in why], "rejected_by": why,
            }

    return map_batches(
        docs.select(F.col(id_col), F.col(text_col)),
        run,
        f"`{id_col}` {type_of(docs, id_col)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string",
    )


def keep_good(docs: DataFrame, order: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the base and every rule keep."""
    order = order or [r for r, _, _ in fit_cascade(docs, text_col=text_col)]
    every = BASE | RULES
    return filter_batches(docs, text_col, lambda: lambda texts: [verdict(Text(t), order, every) is None for t in texts])

"""Operator 4, language identification by interpolated Kneser-Ney character models.

Training words come from labelled documents in hash order up to ``sample_chars``
characters a language, but ``LEAST_DOCS`` documents at least (whole texts; a
documented bound). Words are counted by Spark; the small table (language, word, count)
fits, on the driver, one five-gram model a language, with absolute discounts and
continuation counts in the lower orders (raw counts for grams that begin a word,
which nothing extends to the left). Grams of an order are 64-bit hashes in
one sorted array, with a column of weights per language beside it.

A text scores as its words (runs of letters, lower case, with begin and end
marks): the language of the lowest cross-entropy a character wins. ``score`` is that
language's share of the likelihoods of ``EVIDENCE`` characters at most. A text is
``rejected`` if its entropy lies further above the language's mean than a
calibrated bound, on a scale that widens as one over the root of the length up to
``LENGTH_CAP`` characters. The bound is ``slack`` times the quantile ``keep`` over all
labelled documents of a fold kept out of the fit. Fewer rows than that quantile takes
are pooled with the other languages', and their tail is carried on as an exponential
one; no bound is laxer than the entropy of evenly drawn letters.

Defined cases: very long texts are read whole; a null text, or one without a letter, gets ``und`` and score 0;
unlabelled documents never train; with nothing to learn from, all are ``und``;
ties go to the first language in code-point order; a null id hashes as ''.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.llm.common import filter_batches, map_batches, materialise, type_of

ORDER = 5
UNDETERMINED = "und"
#: Code points of the marks around a word; no letter is one.
BEGIN, END = 2, 3
#: Words whose scores a process holds at most; characters beyond which rejection narrows no more; and beyond which ``score`` gets no surer.
MAX_CACHE, LENGTH_CAP, EVIDENCE = 400_000, 16, 50
#: Documents a language is fitted on at least, if it has them, and rows below which its calibration leans on the others'.
LEAST_DOCS, FEW_ROWS = 100, 20

_WORD = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    words = _WORD.findall((text or "").lower())
    return words if any(w.isalpha() or any(c.isalpha() for c in w) for w in words) else []


def fold(id_col: str = "doc_id", folds: int = 4) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def _positions(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(chars, word)``: per predicted character its last ORDER code points, and the word's index."""
    text = "".join(chr(BEGIN) * (ORDER - 1) + w + chr(END) for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.flatnonzero(code == END)
    grams = np.lib.stride_tricks.sliding_window_view(code, ORDER) if len(code) >= ORDER else np.zeros((0, ORDER), np.uint64)
    keep = grams[:, -1] != BEGIN
    where = np.arange(ORDER - 1, len(code))[keep]
    return grams[keep], np.searchsorted(end, where)


def _hash(grams: np.ndarray) -> np.ndarray:
    out = np.full(len(grams), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(grams.shape[1]):
        out = (out ^ grams[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out


@dataclass
class Model:
    """Per order: sorted hashes of grams and contexts, with a column of weights per language."""

    languages: list[str]
    floor: float
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray | None = None
    bound: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Negative log probabilities of each word, its end mark included, by language."""
        grams, word = _positions(words)
        p = np.full((len(grams), len(self.languages)), self.floor, np.float64)
        for k in range(1, ORDER + 1):
            alpha = _look_up(self.grams[k - 1], _hash(grams[:, ORDER - k :]), 0.0)
            gamma = _look_up(self.contexts[k - 1], _hash(grams[:, ORDER - k : -1]), 1.0)
            p = alpha + gamma * p
        out = np.zeros((len(words), len(self.languages)))
        if len(grams):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[start]] = np.add.reduceat(-np.log(p), start, axis=0)
        return out


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    hashes, weights = table
    at = np.searchsorted(hashes, keys)
    at[at == len(hashes)] = 0
    return np.where((hashes[at] == keys)[:, None], weights[at], missing) if len(hashes) else np.full((len(keys), weights.shape[1]), missing)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([h for h, _ in parts]))
    out = np.full((len(keys), len(parts)), missing, np.float32)
    for i, (h, w) in enumerate(parts):
        out[np.searchsorted(keys, h), i] = w
    return keys, out


def fit_model(counts: dict[str, dict[str, int]], discount: float = 0.75) -> Model:
    """Interpolated Kneser-Ney models of word counts by language."""
    languages = sorted(counts)
    grams: list[list] = [[] for _ in range(ORDER)]
    contexts: list[list] = [[] for _ in range(ORDER)]
    alphabet: set[int] = set()
    for lang in languages:
        words = sorted(counts[lang])
        found, word = _positions(words)
        weight = np.fromiter((counts[lang][w] for w in words), np.float64, len(words))[word]
        alphabet.update(np.unique(found[:, -1]).tolist())
        longer: np.ndarray | None = None  # the kinds of the order above
        for k in range(ORDER, 0, -1):
            h, first, at = np.unique(_hash(found[:, ORDER - k :]), return_index=True, return_inverse=True)
            kinds, n = found[first, ORDER - k :], np.bincount(at, weight, len(h))
            if longer is not None:  # lower orders count distinct left extensions, but nothing extends a word's begin
                extended = np.bincount(np.searchsorted(h, _hash(longer[:, 1:])), minlength=len(h))
                n = np.where(kinds[:, 0] == BEGIN, n, extended)
            context, ctx = np.unique(_hash(kinds[:, :-1]), return_inverse=True)
            total, types = np.bincount(ctx, n), np.bincount(ctx)
            grams[k - 1].append((h, np.maximum(n - discount, 0) / total[ctx]))
            contexts[k - 1].append((context, discount * types / total))
            longer = kinds
    return Model(languages, 1.0 / (len(alphabet) + 1), [_merge(g, 0.0) for g in grams], [_merge(c, 1.0) for c in contexts])


class Scorer:
    """Scores texts with one model, remembering the words' scores."""

    def __init__(self, model: Model) -> None:
        self.model, self.index = model, {}
        self.scores, self.length = np.zeros((0, len(model.languages)), np.float32), np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(cross-entropy by language, characters)`` of each text; 0 characters: no letter."""
        if len(self.index) > MAX_CACHE:
            self.__init__(self.model)
        index, known = self.index, len(self.index)
        rows = [[index.setdefault(w, len(index)) for w in letter_words(t)] for t in texts]
        if len(index) > known:
            new = list(index)[known:]
            self.scores = np.concatenate([self.scores, *(self.model.word_scores(new[i : i + 20_000]).astype(np.float32) for i in range(0, len(new), 20_000))])
            self.length = np.concatenate([self.length, np.fromiter((len(w) + 1 for w in new), np.int64, len(new))])
        sums, chars = np.zeros((len(texts), self.scores.shape[1])), np.zeros(len(texts), np.int64)
        for i, r in enumerate(rows):
            if r:
                at = np.array(r)
                sums[i], chars[i] = self.scores[at].sum(axis=0, dtype=np.float64), self.length[at].sum()
        return sums / np.maximum(chars, 1)[:, None], chars


def _scale(chars: np.ndarray) -> np.ndarray:
    return np.sqrt(np.minimum(chars, LENGTH_CAP))


def train(docs: DataFrame, sample_chars: int = 1_000_000, keep: float = 0.999, slack: float = 1.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2) -> Model | None:
    """Fit on a hash sample of two folds, calibrate rejection on all labelled rows of another."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col) != held_out))
    calibrates = fold(id_col) == (held_out + 1) % 4
    # buckets of draws in hash order, finer towards 0, so that a few hundred a language tell where the sample ends
    draw = F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col), F.col(text_col)), F.lit(1 << 30))
    fitting = labelled.where(~calibrates).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.floor(F.log2(draw + 1) * 64).alias("bucket"))
    ends: dict[str, int] = {}
    taken: dict[str, tuple[int, int]] = {}
    full = set()
    for lang, bucket, n, chars in sorted(tuple(r) for r in fitting.groupBy("lang", "bucket").agg(F.count(F.lit(1)), F.sum(F.length("text"))).collect()):
        n_before, chars_before = taken.get(lang, (0, 0))
        if lang in full or n_before >= LEAST_DOCS and chars_before + chars > sample_chars:
            full.add(lang)
            continue
        ends[lang], taken[lang] = bucket, (n_before + n, chars_before + chars)
    if not ends:
        return None
    end = F.create_map(*(F.lit(x) for pair in ends.items() for x in pair))[F.col("lang")]
    sample = fitting.where(F.col("bucket") <= end).select("lang", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in letter_words(text))
        yield {"lang": [k[0] for k in seen], "word": [k[1] for k in seen], "n": list(seen.values())}

    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in map_batches(sample, words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n")).collect():
        counts.setdefault(lang, {})[word] = n
    if not counts:
        return None
    model = fit_model(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        score = Scorer(shared.value)
        at = {lang: i for i, lang in enumerate(shared.value.languages)}
        for b in batches:
            langs = b.column(0).to_pylist()
            h, n = score(b.column(1).to_pylist())
            use = [i for i, lang in enumerate(langs) if lang in at and n[i]]
            yield {"lang": [langs[i] for i in use], "h": [h[i, at[langs[i]]] for i in use], "scale": _scale(n[use]) if use else []}

    rows = labelled.where(calibrates).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    calibrate(model, materialise(map_batches(rows, entropies, "lang string, h double, scale double"), "entropies"), keep, slack)
    return model


def calibrate(model: Model, entropies: DataFrame, keep: float, slack: float) -> None:
    """Set the means and bounds from all rows ``(lang, h, scale)``.

    Percentiles are taken of values on a grid, so that their tables stay small
    however many rows there are. A language with fewer rows than show the quantile
    takes the larger of its own and that of all languages' rows together, and with
    ``FEW_ROWS`` or fewer the larger median, too; one without a row has the entropy of
    evenly drawn letters as its mean.
    """
    even, root, enough = -float(np.log(model.floor)), LENGTH_CAP**0.5, 1 / (1 - keep)
    median = F.percentile(F.round("h", 3), F.lit(0.5))
    own = {r[0]: (r[1], r[2]) for r in entropies.groupBy("lang").agg(F.count(F.lit(1)), median).collect()}
    of_all = entropies.agg(median).first()[0]
    means = {}
    for lang in model.languages:
        n, middle = own.get(lang, (0, even))
        means[lang] = min(middle if n >= FEW_ROWS or not n else max(middle, of_all), even)
    mean = F.create_map(*(F.lit(x) for pair in means.items() for x in pair))[F.col("lang")]
    over = entropies.select("lang", F.round((F.col("h") - mean) * F.col("scale"), 2).alias("over"))
    high = F.percentile("over", F.lit(keep))

    def tail(n: int, quantile: float) -> float:
        return quantile * max(1.0, np.log(enough) / np.log(max(n, 2)))

    rows = sum(n for n, _ in own.values())
    pooled = tail(rows, over.agg(high).first()[0] or 0.0)
    found = {lang: tail(own[lang][0], q) for lang, q in over.groupBy("lang").agg(high).collect()}
    found = {lang: q if own[lang][0] >= enough else max(q, pooled) for lang, q in found.items()}
    model.mean = np.array([means[lang] for lang in model.languages])
    # without a row to calibrate on, evenly drawn letters alone bound a language
    wide = np.array([slack * found[lang] if lang in found else np.inf if not rows else slack * pooled for lang in model.languages])
    model.bound = np.where(model.mean < even, np.minimum(wide, (even - model.mean) * root), np.where(np.isfinite(wide), wide, root))


def predict(score: Scorer | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``(language, score, rejected)`` of each text."""
    if score is None:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    model = score.model
    h, n = score(texts)
    best = h.argmin(axis=1)
    low = h[np.arange(len(h)), best]
    odds = np.exp(-np.minimum(n, EVIDENCE)[:, None] * (h - low[:, None]))
    over = (low - model.mean[best]) * _scale(n) > model.bound[best]
    langs = [model.languages[i] if c else UNDETERMINED for i, c in zip(best, n, strict=True)]
    return langs, np.where(n > 0, 1.0 / odds.sum(axis=1), 0.0), (n == 0) | over


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, rejected)`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        score = Scorer(shared.value) if shared.value else None
        for b in batches:
            lang, p, rejected = predict(score, b.column(1).to_pylist())
            yield {id_col: b.column(0), "lang_pred": lang, "score": p, "rejected": rejected}

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {type_of(docs, id_col)}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language isn't rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        score = Scorer(shared.value) if shared.value else None
        return lambda texts: (~predict(score, texts)[2]).tolist()

    return filter_batches(docs, text_col, judge)

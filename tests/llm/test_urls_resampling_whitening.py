"""URL filters, importance resampling and embedding whitening against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shoalspark.llm import resampling, urls, whitening
from shoalspark.llm.common import table
from shoalspark.llm.queries import LISTED_HOSTS, QUERIES, URL_RULES

RULES = "host string, path string, verdict string"


# -- URL filters


def split_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = re.match("[^?#]*", rest[len(host) :])[0]
    query = re.match(r"[^?#]*\?([^#]*)", rest)
    kept = sorted(x for x in (query[1] if query else "").split("&") if x and not re.match(r"(utm_[a-z]+|gclid|fbclid|ref)(=|$)", x))
    bare = re.sub(r"^www\.", "", re.sub(":(80|443)$", "", re.sub("^[^@]*@", "", lower)))
    return lower, path, bare + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def judged(url, rules, listed):
    host, path, canonical = split_url(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return (host, path, *max(fits)[2:])
    return host, path, None, "block" if canonical is not None and canonical in listed else "allow"


ODD_URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://WWW.A.Example.ORG/es/x?b=2&a=1&utm_source=q#f", "http://example.org/es/", "http://example.org/es", "http://example.org", "https://org/",
    "http://u:p@org:443/x/", "http://x.com/fr/", "http://xcom/fr/", "http://x.com/de/1", "http://x.com/en/?ref=1&&z", "http://x.com?z=1", "http://x.com#/fr/", "http://y.com/a://b.org/?q#://c?d",
    "http://" + "a." * 3000 + "org/en/1", "http://x.com/" + "p" * 50_000, "http://İI.example.org/en/12", "http://x.com/en/?z", "http://x.com/en", "http://www.x.com/en/#a",
]


@pytest.mark.parametrize("settings", [{}, {"max_blocks": 1, "bits_per_key": 1}, {"hot": 2}])
def test_urls_equal_brute_force(spark, settings):
    rules = [*URL_RULES, ("b.org", "/", "allow"), ("b.org", "/", "block"), ("", "/", "block"), ("net", "", "block")]
    listed = ["http://x.com/en/?z", "https://WWW.x.com/en", None, "plain", "http://y.com/never"]
    pages = spark.createDataFrame([(i, u, 1, "k") for i, u in enumerate([*ODD_URLS, *ODD_URLS, *["http://same.net/a"] * 50])] + [(None, "http://q.net/", 1, "k")], "page_id long, url string, row int, kind string")
    got = urls.filter_urls(pages, spark.createDataFrame(rules, RULES), spark.createDataFrame([(u,) for u in listed], "url string"), **settings)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    known = {split_url(u)[2] for u in listed} - {None}
    want = Counter((r["page_id"], *judged(r["url"], rules, known)) for r in pages.collect())
    assert Counter(map(tuple, got.collect())) == want
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}


def test_urls_empty_tables(spark):
    none = spark.createDataFrame([], "url string")
    no_rules = spark.createDataFrame([], RULES)
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, None)], "page_id long, url string")
    assert [r["verdict"] for r in urls.filter_urls(pages, no_rules, none).collect()] == ["allow", "allow"]
    assert urls.filter_urls(pages.limit(0), spark.createDataFrame(URL_RULES, RULES), pages).count() == 0


def test_bloom_filter_loses_nothing_and_lets_little_through(spark):
    keys = spark.range(20_000).selectExpr("0 AS kind", "concat('k', id) AS key")
    blocks = 20_000 * urls.BITS_PER_KEY // 512
    bloom = urls.bloom_blocks(keys, blocks).cache()
    assert urls.possible_hits(keys, bloom, blocks).count() == 20_000
    others = spark.range(20_000).selectExpr("0 AS kind", "concat('other', id) AS key")
    assert urls.possible_hits(others, bloom, blocks).count() < 400


def test_urls_query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").collect()
    known = {split_url(p["url"])[2] for p in pages if re.search(LISTED_HOSTS, split_url(p["url"])[0])}
    got = {r["page_id"]: tuple(r)[1:] for r in QUERIES["op11_url_filters"](spark, sf_dir).collect()}
    assert got == {p["page_id"]: judged(p["url"], URL_RULES, known) for p in pages}


# -- importance resampling


def plain_runs(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target):
    s, t = Counter(), Counter()
    for text in docs.values():
        s.update(plain_runs(text)[1])
    for text in target:
        t.update(plain_runs(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows, order = {}, []
    for i, text in docs.items():
        n, found = plain_runs(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows[i] = [len(found), weight, score, None]
        if n >= 20:
            order.append((-score, i is None, i))
    for rank, (_, _, i) in enumerate(sorted(order)[: 5 * len(order) // 100], 1):
        rows[i][3] = rank
    return {i: tuple(r) for i, r in rows.items()}


def test_resampling_query_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    want = plain_resample(docs, [r["text"] for r in table(spark, sf_dir, "benchmark").collect()])
    got = QUERIES["op12_importance_resampling"](spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_resampling_of_odd_rows(spark):
    words = [f"w{i}" for i in range(40)]
    docs = {1: None, 2: "", 3: "\x00 İstanbul ÀB 12 a-b", None: " ".join(words), -5: "x" * 100_000, 7: " ".join(words * 3000), 1 << 62: " ".join(words[::-1])} | {-(1 << 62) + i: " ".join(words[i:]) for i in range(20)}
    rows = [(i, t, 1, 2, "c") for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, score int, digit string")
    target = spark.createDataFrame([("w1 w2 w3",), (None,)], "text string")
    got = resampling.resample(df, target, digit_bits=16, chunks=3)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain_resample(docs, ["w1 w2 w3"])
    assert resampling.resample(df.limit(0), target).count() == 0
    twice = resampling.resample(df.unionByName(df), target.limit(0), share=100).collect()
    assert sorted(r["rank"] for r in twice if r["rank"]) == list(range(1, 2 * sum(plain_runs(t)[0] >= 20 for t in docs.values()) + 1))


@pytest.mark.parametrize(("bits", "chunks"), [(7, 4), (12, 1024), (16, 1)])
def test_radix_ranks_equal_a_sort(spark, bits, chunks):
    rng = np.random.default_rng(bits)
    scores = [int(s) for s in rng.integers(-50, 50, 400)] + [-(1 << 63), (1 << 63) - 1] * (bits > 7) + [7] * 300  # one score has a third and more of the rows
    ids = [None if i % 97 == 0 else int(rng.integers(-1000, 1000)) for i in range(len(scores))]
    rows = spark.createDataFrame(list(zip(range(len(scores)), ids, scores, strict=True)), "n long, id long, score long").repartition(7)
    rows = rows.selectExpr("(n % 7) * 8589934592 + n AS row", "id", "score")
    order = sorted(rows.collect(), key=lambda r: (-r["score"], r["id"] is None, r["id"] or 0, r["row"]))
    for k in (0, 250, len(order)):
        got = {r["row"]: r["rank"] for r in resampling.radix_ranks(rows, k, bits, chunks).collect()}
        assert got == {r["row"]: i for i, r in enumerate(order[:k], 1)}


def test_radix_ranks_without_any_digit(spark):
    rows = spark.createDataFrame([(i * (1 << 33), 3, 9) for i in range(5)], "row long, id long, score long")
    assert sorted(tuple(r) for r in resampling.radix_ranks(rows, 3).collect()) == [(i << 33, i + 1) for i in range(3)]


# -- whitening


def covariance_of(values, rng):
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    a = (q * values) @ q.T
    return (a + a.T) / 2


def test_inertia_counts_and_components_of_many_spectra():
    rng = np.random.default_rng(3)
    spectra = [
        rng.random(30), [5.0, 5, 5, 1, 1, 0, 0, 0], [1e6, 1, 1e-3, 1e-6, 0], [1 + 1e-9, 1, 1 - 1e-9, 0.5], [2.0], [3.0, 3.0], np.full(12, 4.0), 1.0 / np.arange(1, 65) ** 4, [1 + 2e-15, 1, 1, 0.2],
    ]
    for values in spectra:
        values = np.sort(np.array(values))[::-1]
        a = covariance_of(values, rng)
        for shift in (values[:-1] + values[1:]) / 2:
            if np.abs(values - shift).min() > 1e-9 * values[0]:
                assert whitening.count_above(a, shift) == (values > shift).sum()
        got = whitening.leading_components(a, 4)
        positive = (values > 1e-13 * values[0]).sum()
        assert len(got) == min(4, positive)
        scale = values[0]
        for i, (e, v) in enumerate(got):
            assert abs(e - values[i]) <= 1e-13 * len(a) * scale
            assert np.linalg.norm(a @ v - e * v) <= 1e-13 * len(a) * scale
        vectors = np.stack([v for _, v in got])
        assert np.abs(vectors @ vectors.T - np.eye(len(got))).max() < 1e-6


def plain_whiten(rows):
    """Rows ``(id, vector)`` that are valid -> {(id, place): (deviation, whitened by component)}."""
    xs = [np.floor(256 * np.array(v, np.float64)).astype(np.int64) for _, v in rows]
    fit = np.unique(np.stack(xs), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    y = fit - total / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    axes = vectors[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    out = [(i, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, total, strict=True)), (x - total / n) @ axes) for (i, _), x in zip(rows, xs, strict=True)]
    return n, out, values[::-1][:4] / values.sum()


def test_whitening_query_equals_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    n, want, explained = plain_whiten(rows)
    got = {(r["vec_id"], r["component"]): r for r in QUERIES["op13_embedding_whitening"](spark, sf_dir).collect()}
    assert len(got) == 4 * len(rows)
    signs = [math.copysign(1, got[want[0][0], c]["whitened"] * want[0][2][c - 1]) for c in (1, 2, 3, 4)]
    for i, deviation, w in want:
        for c in (1, 2, 3, 4):
            r = got[i, c]
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert abs(r["whitened"] - signs[c - 1] * w[c - 1]) < 1e-9 and abs(r["explained"] - explained[c - 1]) < 1e-12 and r["identity_error"] < 1e-10


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(8)
    good = [(i, [float(v) for v in rng.integers(-3, 4, 3) / 4.0 - 0.001]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, nan, 2.0]), (104, [1.0, -inf, 2.0]), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0])]
    rows = [*good, *good[:10], (None, good[3][1]), *bad]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, component int, n string")
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, want, explained = plain_whiten([*good, *good[:10], (None, good[3][1])])
    rows = got.collect()
    assert Counter((r["vec_id"], r["deviation"]) for r in rows) == Counter((i, d) for i, d, _ in want for _ in range(3))
    assert {r["n"] for r in rows} == {n} and {r["component"] for r in rows} == {1, 2, 3}
    assert abs(sum({r["component"]: r["explained"] for r in rows}.values()) - 1) < 1e-12
    for odd in (df.limit(0), df.where("vec_id > 99"), df.where("vec_id = 1")):
        assert whitening.whiten(odd).count() == 0


def test_deviations_are_exact_or_null():
    x = np.array([[1 << 20, 3], [1 << 40, 0]])
    assert whitening._deviations(x, 1000, [5, -7]) == [(1000 * (1 << 20) - 5) ** 2 + 3007**2, None]
    assert whitening._deviations(np.array([[2, 3]]), 10, [1, 1]) == [19**2 + 29**2]

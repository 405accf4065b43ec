"""Pages without an article, damaged archives, and extra columns of any name in the pipeline's stages."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalspark.llm import html, simhash, warc

random.seed(1)
STORY = "the river bends along its old bank and water finds a slower way round every stone".split()
P = [" ".join(random.choice(STORY) for _ in range(34)) + "." for _ in range(4)]
MENU = "<ul>" + "".join(f"<li><a href=/x{i}>Link number {i}</a></li>" for i in range(6)) + "</ul>"


# -- pages without an article


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><p>{P[0]}</p><footer>Copyright 2020 all rights</footer></body>", P[:1]),
        (f"<body><nav>{MENU}</nav><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p><footer>Copyright</footer></body>", P[:3]),
        (f"<body><nav>{MENU}</nav>" + "".join(f"<p>{x}</p>" for x in P) + f"<div class=comments><p>{P[1]}</p></div><aside>{P[2]}</aside><footer>c</footer></body>", P),
        (f"<body><header>Site</header><nav>{MENU}</nav><div><p>{P[0]}</p></div><footer>c</footer></body>", P[:1]),
        ("<body>" + f"<div>{MENU}</div>" * 9 + f"<div><h2>A heading here</h2><p>{P[0]}</p><p>{P[1]}</p></div>" + f"<div>{MENU}</div>" * 9, ["A heading here", *P[:2]]),
        ("<body>" + MENU * 9 + f"<h2>A heading here</h2><p>{P[0]}</p><p>{P[1]}</p>" + MENU * 9, ["A heading here", *P[:2]]),
        (f"<div>{MENU}</div><div><h1>Title of it</h1><p>Short line one.</p><p>{P[0]}</p><p>Another short line.</p><p>{P[1]}</p></div>", ["Title of it", "Short line one.", P[0], "Another short line.", P[1]]),
        (f"<div class='related-work'><p>{P[0]}</p><p>{P[1]}</p></div><footer>c</footer>", P[:2]),
        (f"<main><div class='legal-history'><p>{P[0]}</p></div><div id=share-price><p>{P[1]}</p></div></main>", P[:2]),
        (f"<main><p>{P[0]}</p><div class='related-posts'><p>{P[1]}</p></div><div class='comment_body'><p>{P[2]}</p></div></main>", P[:1]),
        (f"<main><p>{P[0]}</p><div data-x='{'y' * 30_000}' class='advert'><p>{P[1]}</p></div></main>", P[:1]),
        ("<main><ul><li>" + "<b>" * 9 + f"one word here<li>two words here</ul><p>{P[0]}</p></main>", ["one word here", "two words here", P[0]]),
        (f"<main><p>{P[0]}</p><div title='class=ad'><p>{P[2]}</p></div></main>", [P[0], P[2]]),
    ],
)
def test_articles_are_whole_beside_any_boilerplate(page, want):
    assert html.main_text(page) == " ".join(want)


def test_long_attributes_are_read_in_linear_time():
    assert list(html.attributes_of(" a='1' B = \"x y\" c d=e/f ='q' \"g")) == [("a", "1"), ("b", "x y"), ("c", ""), ("d", "e/f"), ("'q'", ""), ('"g', "")]
    assert sum(1 for _ in html.attributes_of("class=' " * 200_000)) >= 1
    assert html.main_text("<p " + "class=\"x' " * 200_000 + f">{P[0]}</p>") == P[0]


# -- damaged archives


def test_every_flipped_byte_leaves_the_other_records(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "<p>one"), (2, "http://b.org/", "<p>same"), (3, None, "<p>same"), (4, "u", "<p>four")], "page_id long, url string, html string")
    records = sorted(r["value"] for r in warc.payload_records(pages).select(warc.warc_record().alias("value")).collect())
    data = b"".join(r.encode() + b"\r\n\r\n" for r in records)
    clean = [warc._row(x) for x in warc.salvage(data)]
    assert [r[0] for r in clean] == ["record"] * 4 and {r[4]: (r[5], r[6], r[8]) for r in clean} == {1: ("response", 6, None), 2: ("revisit", 7, 3), 3: ("response", 7, None), 4: ("response", 7, None)}
    for at in range(len(data)):
        for bit in (1, 16, 128):
            rows = [warc._row(x) for x in warc.salvage(data[:at] + bytes([data[at] ^ bit]) + data[at + 1 :])]
            good = [r for r in rows if r[0] == "record"]
            whole = [r for r in clean if not r[1] <= at < r[2]]
            assert [r for r in good if r in whole] == whole
            assert all(r in clean or r[4:] in [c[4:] for c in clean] for r in good)  # nothing altered is believed
            assert rows[0][1] == 0 and rows[-1][2] == len(data) and all(a[2] == b[1] for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize(
    "line",
    [
        b"WARC-Record-ID: <urn:page:99999999999999999999>", b"WARC-Record-ID: <urn:page:" + b"9" * 6000 + b">", b"Content-Length: " + b"5" * 5000, "Content-Length: ٣".encode(), b"Content-Length: -5",
        b"X-Payload-Length: 1x2", b"X-Payload-Length: 7", b"WARC-Refers-To: <urn:page:-9223372036854775809>",
    ],
)
def test_bad_numbers_make_a_gap(line):
    record = lambda *lines: b"WARC/1.1\r\n" + b"\r\n".join(lines) + b"\r\n\r\nhello\r\n\r\n"
    good = record(b"WARC-Record-ID: <urn:page:5>", b"WARC-Type: response", b"Content-Length: 5")
    bad = record(b"WARC-Record-ID: <urn:page:6>", b"WARC-Type: response", b"Content-Length: 5", line)
    rows = [warc._row(x) for x in warc.salvage(good + bad + good)]
    assert [r[0] for r in rows] == ["record", "gap", "record"] and rows[1][1:3] == (len(good), len(good + bad))


def test_headers_of_any_length_are_read(spark):
    frame = spark.createDataFrame([(1, "http://x.org/" + "y" * 17_000_000, "<p>x")], "page_id long, url string, html string")
    assert [tuple(r)[:3] for r in warc.archive_round_trip(frame).select("kind", "page_id", "payload_bytes").collect()] == [("record", 1, 4)]


# -- stages and extra columns

EXTRA = ["id", "of_text", "of_row", "mix_row", "copies", "copy", "Text_Hash", "row_hash", "kept_id", "fp", "root", "least", "key", "row", "size", "n", "b.c"]


def test_stages_keep_extra_columns_of_any_name(spark, sf_dir):
    import corpus_pipeline as p

    text = lambda k: " ".join(f"river{k}x{j} bends past stone{j}x{k}." for j in range(9))
    rows = [(None if k % 9 == 0 else k % 40, text(k % 50), "en", f"s{k % 3}", 1) for k in range(66)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marked = docs.select("*", *(F.concat(F.lit(f"{c}:"), "text", F.coalesce("source", F.lit(""))).alias(c) for c in EXTRA))
    marked = marked.withColumn("a map", F.create_map(F.lit("k"), F.col("text"))).withColumn("maps", F.array(F.create_map(F.lit(1), "text")))
    # among equal ids and texts any source's row may stay, and among equal ids and sizes any text be copied
    for stage, key in ((p.apply_quality_rules, ("doc_id", "text", "source")), (p.drop_near_duplicates, ("doc_id", "text")), (p.mix_to_targets, ("doc_id", "source"))):
        out = stage(spark, marked, sf_dir)
        assert out.columns == marked.columns
        got = out.collect()
        plain = Counter(tuple(r[c] for c in key) for r in stage(spark, docs, sf_dir).collect())
        assert got and Counter(tuple(r[c] for c in key) for r in got) == plain
        for r in got:
            assert all(r[c] == f"{c}:{r['text']}{r['source']}" for c in EXTRA) and r["a map"] == {"k": r["text"]} and r["maps"] == [{1: r["text"]}]
    language = p.identify_language(spark, marked, sf_dir)
    assert language.columns == marked.columns and language.count() >= 0
    assert p.pack_sequences(spark, marked, sf_dir).count() > 0


# -- fingerprints under every layout


@pytest.mark.parametrize(("segments", "hot", "distance"), [(None, 4096, 4), (simhash.LONG_SEGMENTS, 4096, 4), (simhash.SEGMENTS, 20, 4), (simhash.LONG_SEGMENTS, 20, 4), (simhash.SEGMENTS, 1, 7), (simhash.LONG_SEGMENTS, 1, 5)])
def test_links_are_the_same_under_every_layout(spark, segments, hot, distance):
    rng = np.random.default_rng(11)
    fps = set()
    for first, bits in simhash.SEGMENTS:  # values that very many share, in each segment
        common = int(rng.integers(0, 1 << bits)) << first
        for _ in range(60):
            f = int(rng.integers(0, 1 << 63)) * 2 & ~(((1 << bits) - 1) << first) | common
            fps |= {f, *(f ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 8), replace=False)) for _ in range(2))}
    fps = sorted(fps)
    near = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(near[i + 1 :] ^ near[i]) <= distance) + i + 1:
            root[find(int(j))] = find(i)
    frame = spark.createDataFrame([(int(f),) for f in near.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in simhash.connected_components(simhash.links(frame, distance, hot, segments)).collect()}
    groups, want = {}, {}
    for i, f in enumerate(near.view(np.int64).tolist()):
        groups.setdefault(got.get(f, f), set()).add(f)
        want.setdefault(find(i), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and max(map(len, want.values())) > 1


def test_a_hot_value_meets_few_of_its_rows(spark):
    rng = np.random.default_rng(12)
    fps = spark.createDataFrame([(int(f) << 22 | 77,) for f in np.unique(rng.integers(0, 1 << 41, 6000))], "fp long")
    rows = simhash._cut_again(simhash.segment_rows(fps), fps, 4, simhash.SEGMENTS, 500)
    pairs = rows.where("not probe").groupBy("key").count().join(rows.where("probe").groupBy("key").agg(F.count("fp").alias("p")), "key")
    assert pairs.agg(F.sum(F.col("count") * F.col("p"))).first()[0] < 6000 * 6000 / 20


def test_layout_follows_the_number_of_fingerprints():
    assert simhash.layout(1000) == simhash.SEGMENTS and simhash.layout(1 << 30) == simhash.LONG_SEGMENTS and simhash.layout(1 << 30, 9) == simhash.SEGMENTS

"""The training-data operators against brute force, exact round trips and held-out labels."""

import base64
import gzip
import hashlib
import math
import time
import zlib
from collections import Counter, defaultdict
from html import parser as html_parser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shoalspark.llm import html, language, media, mixing, packing, quality, sharding, simhash, tokens, urls, warc
from shoalspark.llm.common import table
from shoalspark.llm.queries import BYTE_PIECES, QUERIES, WORD_PIECES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, probe int, size int"
ODD = [
    (1, "The cat sat on the mat.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "Null id here today, as it is.", "en", None),
    (5, "The cat sat on the mat.", "en", "b"), (5, "The cat sat on the mat.", "en", "b"), (7, " \n\t ", "fr", "b"), (8, "x" * 5000, None, "c"),
    (9, "İıſ ½²³ 日本語 <|endoftext|> <|startoftext|> a b\u0085c  d", "en", "c"), (10, "one two three " * 4000, "fr", "c"), (11, "123 456 !!", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "k", 1, 2, 3) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- media


def test_png_round_trip_with_all_filters_and_checks():
    rng = np.random.default_rng(1)
    for n in (64, 128, 6400, 64 * 1001):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        png = media.to_png(payload)
        assert media.from_png(png).tobytes() == payload
        with pytest.raises(ValueError):
            media.from_png(png[:50] + bytes([png[50] ^ 1]) + png[51:])
        with pytest.raises(ValueError):
            media.from_png(png[:-7])
    image = rng.integers(0, 256, (40, 64), dtype=np.uint8)
    rows, above = np.zeros((40, 65), np.uint8), np.zeros(64, np.uint8)
    for i, row in enumerate(image):  # the reverse of each filter, pixel by pixel
        kind = rows[i, 0] = i % 5
        for j in range(64):
            a, b, c = (int(row[j - 1]), int(above[j]), int(above[j - 1])) if j else (0, int(above[j]), 0)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(p - v))][kind]
            rows[i, j + 1] = (int(row[j]) - guess) % 256
        above = row
    assert (media.unfilter(rows) == image).all()


def test_dct_hash_is_stable_under_noise_and_tells_images_apart():
    rng = np.random.default_rng(2)
    first, other = (np.kron(rng.integers(20, 230, (8, 8)), np.ones((8, 8))) for _ in range(2))
    noisy = first + rng.normal(0, 2, (64, 64))
    h = [int(media.dct_hash(x.astype(np.uint8)), 16) for x in (first, noisy, other)]
    assert (h[0] ^ h[1]).bit_count() <= 6 < 16 <= (h[0] ^ h[2]).bit_count()


def test_media_columns(odd, docs, nothing):
    for frame in (odd, docs):
        rows = media.decode_media(media.encode_media(frame)).collect()
        texts = Counter((r["doc_id"], r["text"] or "") for r in frame.collect())
        assert len(rows) == sum(texts.values())
        expected = Counter()
        for (i, t), n in texts.items():
            raw = t.encode()
            full = raw + b"\0" * (-len(raw) % 64 if raw else 64)
            expected[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += n
        assert Counter((r[0], r[1], r[2], r[3], r[4]) for r in rows) == expected
        assert all(len(r["feature"]) == 16 and r["error"] is None for r in rows)
    assert media.decode_media(media.encode_media(nothing)).count() == 0


def test_ids_of_any_type_pass_through(spark, odd):
    frame = odd.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    ids = Counter(r["doc_id"] for r in frame.collect())
    path = tokenizer_path(WORD_PIECES)
    for out in (
        media.decode_media(media.encode_media(frame)), quality.quality_cascade(frame), tokens.token_counts(frame, path), language.identify(frame, language.train(frame)),
        sharding.shard_documents(frame), simhash.near_duplicates(frame), mixing.mix_sources(frame),
    ):
        assert Counter(r["doc_id"] for r in out.collect()) == ids
    assert {r["doc_id"] for r in packing.pack(frame, tokenizer_path(BYTE_PIECES)).collect()} == set(ids)
    least = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame).collect()}
    assert least["doc-5"] == "doc-1" and least["doc-3"] == "doc-2"


# -- quality


def brute_counts(text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    seen = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {j for i in range(n - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_order_independence(odd, docs, nothing):
    for frame in (odd, docs):
        every = [*quality.BASE, *quality.RULES]
        a = sorted(map(str, quality.quality_cascade(frame, every).drop("rejected_by").collect()))
        assert a == sorted(map(str, quality.quality_cascade(frame, every[::-1]).drop("rejected_by").collect()))
        got = Counter((r[0], r[1], r[2], r[3], r[4], r[5]) for r in quality.quality_cascade(frame, every).collect())
        assert got == Counter((r["doc_id"], *brute_counts(r["text"])) for r in frame.collect())
    assert quality.quality_cascade(nothing).count() == 0


def test_cascade_puts_rejection_per_cost_first(spark):
    rows = [(i, ("word%d " % i) * 1 + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    slow = lambda t: sum(hash(w) & 1 for w in t.words * 300) >= 0
    order = [r for r, _, _ in quality.fit_cascade(frame, {"slow": slow, "all": lambda t: False, "none": lambda t: True})]
    assert order[0] == "all" and order.index("none") < order.index("slow") and set(order) == {"slow", "all", "none", *quality.BASE}


def test_a_rejected_text_costs_no_later_statistic():
    t = quality.Text("$$$ %%% *** one two three " * 5)
    assert quality.verdict(t, ["symbols", "few_repeats", "repeated_lines"], quality.BASE | quality.RULES) == "symbols"
    assert not {"n_repeat_words", "lines", "n_dup_lines"} & set(vars(t))


def test_null_and_equal_ids_are_sampled_by_row(spark):
    frame = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three four five six seven eight nine ten eleven").alias("text"))
    assert quality.fit_cascade(frame, {"all": lambda t: True}, sample_rows=400)
    assert 300 < frame.select("text").sample(0.1, 17).count() < 500


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    kept = quality.quality_cascade(table(spark, d, "documents")).join(table(spark, d, "labels"), "doc_id")
    good, lost, bad, caught = kept.agg(
        F.expr("count_if(quality = 1)"), F.expr("count_if(quality = 1 and not kept and not base_failed)"), F.expr("count_if(quality = 0)"), F.expr("count_if(quality = 0 and not kept)")
    ).first()
    assert good and bad and lost == 0 and caught >= 0.95 * bad


# -- tokens


@pytest.mark.parametrize("file", [WORD_PIECES, BYTE_PIECES])
def test_token_counts_equal_the_library(odd, docs, nothing, file):
    path = tokenizer_path(file)
    library = tokens.load_tokenizer(path)
    for frame in (odd, docs):
        got = Counter(tuple(r) for r in tokens.token_counts(frame, path).collect())
        want = Counter()
        for r in frame.collect():
            t = r["text"] or ""
            n = len(library.encode(t, add_special_tokens=False).ids)
            want[r["doc_id"], len(t.encode()), n, n > 2048] += 1
        assert got == want
    assert tokens.token_counts(nothing, path).count() == 0


def test_the_plain_split_is_only_taken_where_it_is_the_tokenizers():
    assert tokens.PreTokenizer(tokenizer_path(WORD_PIECES)).plain and not tokens.PreTokenizer(tokenizer_path(BYTE_PIECES)).plain


# -- language


def twin_entropy(words, text_words, order=5, discount=0.75):
    """Kneser-Ney from its definitions, gram by gram: mean negative log probability of a character."""
    padded = lambda w: ["<"] * (order - 1) + list(w) + [">"]
    raw = Counter()
    for w, n in words.items():
        seq = padded(w)
        for i in range(order - 1, len(seq)):
            for k in range(1, order + 1):
                raw[tuple(seq[i - k + 1 : i + 1])] += n
    before = defaultdict(set)
    for g in raw:
        before[g[1:]].add(g[0])
    count = {g: n if len(g) == order or g[0] == "<" else len(before[g]) for g, n in raw.items()}
    follow = defaultdict(dict)
    for g, n in count.items():
        follow[g[:-1]][g[-1]] = n
    letters = {g[-1] for g in raw}

    def p(context, c):
        low = 1 / (len(letters) + 1) if not context else p(context[1:], c)
        if context == ():
            seen = follow[()]
            return max(seen.get(c, 0) - discount, 0) / sum(seen.values()) + discount * len(seen) / sum(seen.values()) * (1 / (len(letters) + 1))
        if context not in follow:
            return low
        seen = follow[context]
        return max(seen.get(c, 0) - discount, 0) / sum(seen.values()) + discount * len(seen) / sum(seen.values()) * low

    total = chars = 0
    for w in text_words:
        seq = padded(w)
        for i in range(order - 1, len(seq)):
            total -= math.log(p(tuple(seq[i - order + 1 : i]), seq[i]))
            chars += 1
    return total / chars


def test_cross_entropies_equal_a_twin_from_the_definitions(docs):
    words = Counter()
    for r in docs.where("lang = 'en'").limit(15).collect():
        words.update(language.letter_words(r["text"]))
    score = language.Scorer(language.fit_model({"en": dict(words)}))
    for text in ("then the thing", "xylophone qqq", "a", "Ärger of the"):
        h, n = score([text])
        tokens_ = language.letter_words(text)
        assert n[0] == sum(len(w) + 1 for w in tokens_)
        assert math.isclose(h[0, 0], twin_entropy(words, tokens_), rel_tol=1e-5)


def test_kneser_ney_sums_to_one_and_held_out_accuracy(spark, odd, nothing):
    model = language.fit_model({"a": {"abab": 3, "abc": 1}, "b": {"xyx": 2}})
    letters = "abcxyz\3"  # with one unseen letter, all that can follow
    grams = np.array([[*map(ord, "\2" * 3 + "ab"[-1:] + c)][-5:] for c in letters], np.uint64)
    p = np.full((len(grams), 2), model.floor)
    for k in range(1, language.ORDER + 1):
        p = language._look_up(model.grams[k - 1], language._hash(grams[:, 5 - k :]), 0.0) + language._look_up(model.contexts[k - 1], language._hash(grams[:, 5 - k : -1]), 1.0) * p
    assert np.allclose(p.sum(axis=0), 1.0, atol=1e-6)
    d = table(spark, "/root/testdata/sf0.01", "documents")
    found = language.identify(d, language.train(d)).join(d.select("doc_id", "lang"), "doc_id").where(language.fold() == 2)
    n, right, rejected = found.agg(F.count("*"), F.expr("count_if(lang = lang_pred)"), F.expr("count_if(rejected)")).first()
    assert right >= 0.98 * n and rejected <= 0.01 * n
    rows = language.identify(odd, language.train(odd)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 7, 11)} == {"und"}
    assert language.identify(nothing, language.train(nothing)).count() == 0


def test_language_learns_nothing_from_the_held_out_fold(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents")
    other = d.withColumn("lang", F.when(language.fold() == 2, F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted(map(str, language.identify(d, language.train(x)).collect())) for x in (d, other))
    assert a == b


def test_gibberish_and_other_languages_are_rejected_at_any_length(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.train(d)
    texts = ["qzxkvjw wqxzj kqqzv xjqkz qzxkvjw"[:n] for n in (3, 5, 10, 20, 33)]
    texts += ["tämä on suomenkielinen teksti jossa puhutaan monista asioista", "to jest tekst napisany w języku polskim", "это текст на русском языке", "这是一个中文文本", "questo è un testo scritto in italiano"]
    junk = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert language.identify(junk, model).where("rejected").count() == len(texts)
    assert language.identify(d, model).where("rejected").count() <= 0.005 * d.count()


def test_gibberish_is_rejected_whatever_the_size_of_the_table(spark):
    junk = " ".join("qzxkvjw wqxzj kqqzv xjqkz" for _ in range(20))
    score = lambda model: language.predict(language.Scorer(model), [junk])[2][0]
    d = table(spark, "/root/testdata/sf0.001", "documents")
    model = language.train(d)  # one to ten rows of three languages calibrate
    assert np.isfinite(model.bound).all() and score(model)
    assert language.identify(d, model).where("rejected").count() <= 0.01 * d.count()
    few = language.train(d, sample_chars=3000)  # texts as long as the sample
    assert np.isfinite(few.bound).all() and score(few)
    uncalibrated = language.train(d.where(language.fold() != 3))
    assert np.isfinite(uncalibrated.bound).all() and score(uncalibrated)
    assert language.identify(d, uncalibrated).where("rejected").count() <= 0.01 * d.count()


def test_labelled_junk_does_not_switch_rejection_off(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    junk = " ".join("qzxkvjw wqxzj kqqzv xjqkz" for _ in range(20))
    i = next(i for i in range(10**7, 10**7 + 100) if zlib.crc32(str(i).encode()) % 4 == 3)
    model = language.train(d.unionByName(spark.createDataFrame([(i, junk, "en")], d.schema)))
    assert language.predict(language.Scorer(model), [junk])[2][0]


# -- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="page-with-sidebar">
<header><a href=/>Site</a> of things</header><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies on this site. They are good.</div><article><h1>A  title</h1><p>First <b>para</b>graph &amp; so on,
with words.<br>And more of it here.<p>Second one is here as well, it goes on.<div class="ad">Buy this now, it is cheap.</div><p>Short one.</p></article>
<aside>Read also these things of ours.</aside><div id="comments"><p>I liked the article a lot, thank you.</p></div>
<form><p>Subscribe to our letter with your address.</p></form><footer>&copy; us 2020. All rights are reserved.</footer></body></html>"""


def test_main_text_of_a_page():
    assert html.main_text(PAGE) == "A title First paragraph & so on, with words. And more of it here. Second one is here as well, it goes on. Short one."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p><script>x</script>") == ""


@pytest.mark.parametrize("head", ["<head><title>T</title><meta charset=utf-8><style>p{}</style>", "<html><HEAD><title>T</title>", "<head><title>T</title><script>x</script></head>", "<head><noscript><link href=x></noscript>"])
@pytest.mark.parametrize("body", ["<body>", "", "<body><div>", "<div><head>"])
def test_an_omitted_head_end_hides_no_text(head, body):
    text = "The text of this page goes on for some words, as it should."
    assert html.main_text(f"{head}{body}<p>{text}") == text
    assert html.main_text(f"{head}{body}{text}") == text


@pytest.mark.parametrize("tag", ["button", "select", "object", "svg", "math", "canvas", "audio", "video"])
def test_unclosed_silent_elements_hide_no_block(tag):
    text = "The text of this page goes on for some words, as it should."
    for label in ("", "Share", "<option>A<option>B"):
        assert html.main_text(f"<body><main><{tag} class=x>{label}<p>{text}</p><p>{text}</p><{tag}>Save</{tag}></main></body>") == f"{text} {text}"
    assert html.main_text(f"<main><p>{text}</p><{tag}><div>{text}</div></{tag}><p>{text}</p></main>") == f"{text} {text}"


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, '<a ">" ' * 150_000, '<p class="x>t ' * 60_000, "<div>" * 40_000 + "</b></i></x>" * 60_000, "<script>" * 120_000, "<script></script" * 60_000, "<svg><button>" * 60_000, "<p>x</p>" * 60_000, "<div>x" * 50_000],
)
def test_malformed_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - began < 15  # a second or two; quadratic reading takes minutes


def test_broken_tags_are_text_or_tags():
    text = "The text of this page goes on for some words, as it should."
    assert html.main_text(f"<p>{text}</p><p>1 < 2 and that is how it goes here, too.") == f"{text} 1 < 2 and that is how it goes here, too."
    assert html.main_text(f'<p class="a>{text}</p><p>{text}</p>') == f"{text} {text}"  # without a second quote the tag ends at its >
    assert html.main_text(f"<p title='a>b'>{text}</p>") == text


def test_containers_outvote_length():
    text, long = "The text of this page goes on for some words, as it should.", "I read all of this with care and I do think that it is good. " * 12
    for box in ("<div class=comments><p>{}</p></div>", "<aside><p>{}</p></aside>", "<div id=ad-1><p>{}</p></div>", "<section class='related'><article><p>{}</p></article></section>", "<article class=comment><p>{}</p></article>"):
        assert html.main_text(f"<main><article><h1>News</h1><p>{text}</p><p>Yes.</p>{box.format(long)}</article></main>") == f"News {text} Yes."
        assert html.main_text(f"<article><h1>News</h1><p>{text}</p><p>Yes.</p></article>{box.format(long)}") == f"News {text} Yes."
    assert html.main_text(f"<div class='content sidebar'><article><p>{text}</p></article></div>") == text  # a wrapper's class name


class _TwinParser(html_parser.HTMLParser):
    """Blocks of a well-formed page by the standard library: (text, tag path, own link share)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.text, self.out, self.next, self.links = [("", 0)], [], [], 1, 0

    def close_block(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.out.append((text, tuple(self.path), self.links))
        self.text, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "b"):
            self.path.append((tag, -1)) if tag == "a" else None
            return
        self.close_block()
        self.path.append((tag + "".join(f".{v}" for k, v in attrs if k == "class"), self.next))
        self.next += 1

    def handle_endtag(self, tag):
        if tag == "b":
            return
        if tag != "a":
            self.close_block()
        self.path.pop()

    def handle_data(self, data):
        if not any(t in ("script", "style", "head") for t, _ in self.path):
            self.text.append(data)
            self.links += len(data.split()) * any(t == "a" for t, _ in self.path)


def twin_text(page):
    """The least-cost labelling by trying all, with costs written out from the docstring."""
    parser = _TwinParser()
    parser.feed(page)
    parser.close_block()
    blocks = [(t, tuple(x for x in path if x[0] != "a"), links) for t, path, links in parser.out]
    w = html.WEIGHTS
    boiler = lambda path: any(t.split(".")[0] in ("nav", "footer", "aside") or t.endswith(".ad") for t, _ in path)
    inside = lambda path: any(t == "article" for t, _ in path)
    some = any(inside(p) for _, p, _ in blocks)
    below_of = lambda e: [b for b in blocks if b[1][: len(e)] == e]
    words = lambda e: sum(len(t.split()) for t, _, _ in below_of(e))
    menu = lambda e: 2 * sum(k for _, _, k in below_of(e)) > words(e)

    def share(e):  # of an element's tie to its parent
        if menu(e):
            return 1 / len({p[: len(e)] for _, p, _ in blocks if p[: len(e) - 1] == e[:-1] and len(p) >= len(e) and menu(p[: len(e)])})
        return len(below_of(e)) if inside(e[:-1]) and not boiler(e[:-1]) else 1

    nodes, gain = {}, []
    node = lambda key, g: nodes.setdefault(key, (len(nodes), gain.append(g)))[0]
    edges = []
    for i, (text, path, links) in enumerate(blocks):
        n = len(text.split())
        g = w["bias"] + w["log_words"] * math.log(1 + n) + w["links"] * links / n + w["sentence"] * (text[-1] in ".!?" and n > 3) + w["outside_article"] * (some and not inside(path))
        g += {"p": w["paragraph"], "h1": w["heading"], "li": w["list_item"]}.get(path[-1][0], 0.0)
        b = node(("block", i), w["boilerplate"] if boiler(path) else g)
        for d in range(len(path), 0, -1):
            e = path[:d]
            new = e not in nodes
            here = node(e, w["boilerplate"] if boiler(e) else 100.0 if e[-1][0] == "article" else 0.0) if new else nodes[e][0]
            if d == len(path):
                edges.append((b, here, html.LOOSE_TIE, html.BLOCK_TIE))
            if d < len(path) and below is not None and path[d][0] != "article" and (boiler(e) or not boiler(path[: d + 1])):  # noqa: F821
                edges.append((below, here, html.LOOSE_TIE, html.ELEMENT_TIE * share(path[: d + 1])))  # noqa: F821
            below = here if new else None
        if i:
            last = blocks[i - 1][1]
            common = sum(1 for x, y in zip(last, path) if x == y)
            beside = html.ADJACENT / 2 ** ((len(last) + len(path) - 2 * common) / 2)
            edges.append((nodes[("block", i - 1)][0], b, beside, beside))
    if not some:  # elements by the words of their own paragraphs
        own = Counter()
        for i, (text, path, _) in enumerate(blocks):
            if gain[nodes[("block", i)][0]] > 0:
                own[path[:-1] if path[-1][0] in ("p", "li") else path] += len(text.split())
        for e, n in own.items():
            if e in nodes and not boiler(e):
                gain[nodes[e][0]] += w["own_words"] * math.log(1 + n / 10)
    best = None
    for m in range(1 << len(gain)):
        cost = sum(g for i, g in enumerate(gain) if not m >> i & 1) + sum(up if m >> x & 1 else down for x, y, up, down in edges if (m >> x ^ m >> y) & 1)
        if best is None or cost < best[0] - 1e-9:
            best = cost, m
    return " ".join(t for i, (t, _, _) in enumerate(blocks) if best[1] >> nodes[("block", i)][0] & 1)


@pytest.mark.parametrize(
    "page",
    [
        "<nav><p><a>Home</a></p></nav><article><h1>Two words</h1><p>Yes.</p><p>It is so, as they all say.</p></article>",
        "<div><p>Short one</p><p>A longer one that says what there is to say about it all.</p></div><div><p><a>Link here</a></p></div>",
        "<div class=ad><p>Buy this thing now, it is so cheap that you will buy two.</p></div><p>Yes, it was told.</p><p>Ok</p>",
        "<ul><li>One</li><li>Two <a>more links here</a></li></ul><p>Then a text of a few more words than that follows on here.</p>",
        "<article><p>Main text here.</p></article><p>Outside of it stands a text of more words than that, which is odd.</p>",
    ],
)
def test_extraction_equals_a_twin_that_tries_all_labellings(page):
    assert html.main_text(page) == twin_text(page)


def test_the_cut_turns_labels_of_the_pages(spark, sf_dir):
    turned = total = 0
    for r in table(spark, sf_dir, "pages").collect():
        cut, alone = html.label_blocks(html.read_page(r["html"]))
        turned += sum(a != b for a, b in zip(cut, alone, strict=True))
        total += len(cut)
    assert turned > 0.02 * total


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        odds = (np.round(rng.normal(0, 1, n) / html.UNIT) * html.UNIT).tolist()
        edges = [(int(a), int(b), *(rng.integers(0, 256, 2) * html.UNIT).tolist()) for a, b in rng.integers(0, n, (2 * n, 2)) if a != b]

        def cost(labels):
            return sum(max(o, 0) - o * keep for o, keep in zip(odds, labels)) + sum(forth if labels[a] else back for a, b, forth, back in edges if labels[a] != labels[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(html.minimum_cut(odds, edges)), best, abs_tol=1e-9)


def test_extraction_keeps_articles_and_drops_the_rest(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rows = html.extract_main_text(pages).collect()
    assert len(rows) == pages.count()
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in rows:
        inner = source[r["page_id"]].split("<article>")[1].split("</article>")[0]
        assert r["text"].split() == html.html_lib.unescape(html.re.sub("<[^>]*>", " ", inner)).split()
        assert r["n_chars"] == len(r["text"])
    extra = spark.createDataFrame([(1, "u", None, "t"), (None, None, "<p>Hello there, this is the text of it.", "t")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html.extract_main_text(extra).collect()) == ["", "Hello there, this is the text of it."]


# -- packing


def test_packing_covers_every_id_once(spark, odd, docs, nothing):
    path = tokenizer_path(BYTE_PIECES)
    library = tokens.load_tokenizer(path)
    for frame in (odd, docs):
        rows = packing.pack(frame, path, length=256).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            pieces[r["doc_id"]].append(r)
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in sequences.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at == 256 or s is sequences[max(sequences)]
        assert sorted(sequences) == list(range(len(sequences)))
        want = Counter()
        for r in frame.collect():
            ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
            want[r["doc_id"], len(ids)] += len(ids)
            for p in pieces[r["doc_id"]]:
                if frame is docs:
                    assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        got = Counter()
        for r in rows:
            got[r["doc_id"], r["doc_tokens"]] += r["length"]
        assert got == want
    assert packing.pack(nothing, path).count() == 0


def test_hilbert_neighbours_are_adjacent():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        key = packing.hilbert_key(grid, bits)
        assert sorted(key) == list(range(1 << bits * d))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_copies_are_packed_side_by_side(spark, docs):
    key = packing.tokenize(docs.unionByName(docs), tokenizer_path(BYTE_PIECES)).groupBy("id").agg(F.count_distinct("key").alias("n"))
    assert key.agg(F.max("n")).first()[0] == 1


# -- mixing


def brute_targets(size, weights=(1, 2, 3), cap=3):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(size.values())), set(names), {}
    while free:
        share = left / sum(w[s] for s in free)
        over = [s for s in free if share * w[s] > cap * size[s]]
        if not over:
            return out | {s: share * w[s] for s in free}
        for s in over:
            out[s] = float(cap * size[s])
            left -= out[s]
            free.discard(s)
    return out


def test_mixing_meets_targets(spark, odd, docs, nothing):
    large = table(spark, "/root/testdata/sf0.01", "documents")
    for frame in (odd, docs, large):
        rows = mixing.mix_sources(frame).collect()
        texts = frame.collect()
        assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], brute_counts(r["text"])[0]) for r in texts)
        size = defaultdict(int)
        for r in texts:
            size[r["source"]] += brute_counts(r["text"])[0]
        target = brute_targets(size)
        assert sorted({(r["source_size"], round(r["target"], 3)) for r in rows}) == sorted({(size[s], round(target[s], 3)) for s in size})
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
        taken, most = defaultdict(int), defaultdict(int)
        for r in rows:
            k = round(r["target"], 3), r["source_size"]
            taken[k] += r["taken"]
            most[k] = max(most[k], r["size"])
        for k, n in taken.items():
            assert abs(n - k[0]) <= most[k] / 2 + 1
    assert sorted(map(str, mixing.mix_sources(large).collect())) == sorted(map(str, mixing.mix_sources(large.repartition(5)).collect()))
    assert mixing.mix_sources(nothing).count() == 0


def test_pivotal_rounding_keeps_expectations(spark):
    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"), F.expr("if(id < 300, 'a', 'b')").alias("source"))
    runs = [mixing.mix_sources(frame, block=8, seed=s).collect() for s in range(12)]
    share = defaultdict(list)
    for rows in runs:
        for r in rows:
            share[r["size"], round(r["target"] / r["source_size"], 9)].append(r["copies"])
    for (_, ratio), copies in share.items():
        assert abs(np.mean(copies) - ratio) < 0.15


def test_equal_rows_are_spread_over_blocks(spark):
    same = spark.range(0, 30_000, 1, 7).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    other = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("t").alias("source"))
    numbered = mixing._numbered(same.select(F.lit("s").alias("source"), F.col("doc_id").alias("id"), F.lit(3).alias("size"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part")))
    assert sorted(r["copy"] for r in numbered.collect()) == list(range(30_000))
    rows = mixing.mix_sources(same.unionByName(other)).groupBy("source_size", "target", "size", "copies").count().collect()
    taken, n = Counter(), Counter()
    for r in rows:
        taken[r["source_size"], r["target"]] += r["size"] * r["copies"] * r["count"]
        n[r["size"]] += r["count"]
    assert n == {3: 30_000, 4: 3000} and all(abs(t - target) <= 2 for (_, target), t in taken.items())
    a, b = (sorted(map(str, mixing.mix_sources(f).collect())) for f in (same, same.repartition(3)))
    assert a == b


# -- warc


def test_archives_round_trip(spark, sf_dir, monkeypatch):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.lit("x").alias("payload"), F.lit(1).alias("digest"))
    more = spark.createDataFrame(
        [(10**6, "http://a\r\nb c", None, "x", 1), (10**6 + 1, None, "", "x", 1), (10**6 + 2, "u", "<p>WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n é</p>", "x", 1), (None, "u", "<p>null id", "x", 1)], pages.schema
    )
    frame = pages.unionByName(more).unionByName(pages.where("page_id < 5").withColumn("page_id", F.col("page_id") + 2 * 10**6))
    rows = warc.archive_round_trip(frame).collect()
    html_of = {r["page_id"]: (r["html"] or "").encode() for r in frame.collect()}
    last = {}
    for i, h in html_of.items():
        last[h] = max(last.get(h, -1), -1 if i is None else i)
    assert {r["kind"] for r in rows} == {"record"} and len(rows) == len(html_of)
    for r in rows:
        h = html_of[r["page_id"]]
        response = r["page_id"] is None or last[h] == r["page_id"]
        assert r["record_type"] == ("response" if response else "revisit")
        assert r["refers_to"] == (None if response else last[h])
        assert r["payload_bytes"] == len(h) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h).digest()).decode()
        assert r["payload"] == (h if response else None)
    assert warc.archive_round_trip(frame.limit(0)).count() == 0
    plain = lambda rows: sorted(str((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["payload"])) for r in rows)
    assert plain(warc.archive_round_trip(frame, hot=0).collect()) == plain(rows)  # all repeated digests by broadcast
    monkeypatch.setattr(urls, "_bits", lambda: [F.lit(1).cast("long").alias(w) for w in urls._WORDS])  # filters that let all through
    assert plain(warc.archive_round_trip(frame, most_blocks=1).collect()) == plain(rows)


def test_large_pages_get_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_PAGE", 1000)
    monkeypatch.setattr(warc, "FILE_BYTES", 10_000)
    frame = spark.createDataFrame([(i, "u", f"{i} " * (10 if i % 3 else 1000 + i)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "warc")
    warc.write_archives(frame, path, records_a_file=7)
    assert max(f.stat().st_size for f in tmp_path.glob("warc/large/*.txt")) < 20_000 and len(list(tmp_path.glob("warc/small/*.txt"))) == 6
    rows = warc.read_archives(spark, path).collect()
    assert {(r["page_id"], r["payload"].decode()) for r in rows} == {(r["page_id"], r["html"]) for r in frame.collect()}


def test_ids_that_are_no_numbers_are_archived_as_null(spark):
    rows = warc.archive_round_trip(spark.createDataFrame([("a", None, "<p>x")], "page_id string, url string, html string")).collect()
    assert [(r["page_id"], r["record_type"], r["payload"]) for r in rows] == [(None, "response", b"<p>x")]


def test_salvage_takes_time_in_proportion():
    rng = np.random.default_rng(5)
    for data, n in ((b"".join(gzip.compress(member(i, rng.bytes(20_000)), 1) for i in range(1500)), 1500), (b"WARC/1.1\r\n" * 200_000, 0)):
        began = time.perf_counter()
        assert sum(x[0] == "record" for x in warc.salvage(data)) == n
        assert time.perf_counter() - began < 10


def member(i, body=b"hello"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Block-Digest: sha1:%s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (
        i, base64.b32encode(hashlib.sha1(block).digest()), len(block)) + block + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_salvage_recovers_records_after_damage(pack):
    parts = [pack(member(i, b"body %d " % i * 20)) for i in range(6)]
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0xFF
    data = parts[0] + b"garbage\x1f\x8b\x08WARC/1.1\r\n" + parts[1] + bytes(bad) + parts[3] + parts[4][:-30] + parts[5]
    found = list(warc.salvage(data))
    ids = [x[3]["warc-record-id"] for x in found if x[0] == "record"]
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 5)]
    assert [x[0] for x in found] == ["record", "gap", "record", "gap", "record", "gap", "record"]
    at = 0
    for x in found:  # records and gaps cover every byte
        assert x[1] == at
        at = x[2]
    assert at == len(data)
    assert [x[0] for x in warc.salvage(data[:-3])][-1] == "gap"


# -- sharding


def twin_shard(key, topology, seed=11):
    """Descent by the definitions: per level an exponential draw for each child from a chained XXH64."""

    def draw(level, path, i, weight):
        h = 42
        number = lambda n: n.to_bytes(4, "little")
        for raw in (number(seed), level.encode(), *map(number, path), number(i), key.to_bytes(8, "little", signed=True)):
            h = xxhash.xxh64_intdigest(raw, h)
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight

    weight = lambda node: node if isinstance(node, float) else sum(map(weight, node))
    node, path = topology, []
    for level in ("region", "rack", "shard"):
        i = min(range(len(node)), key=lambda i: draw(level, path, i, weight(node[i])))
        node, path = node[i], [*path, i]
    before = [r for region in topology[: path[0]] for r in region] + topology[path[0]][: path[1]]
    return sum(map(len, before)) + path[2]


@pytest.mark.parametrize("topology", [sharding.SHARDS_24, sharding.SHARDS_25, [[[1.0, 2.0], [1.0]], [[3.0, 1.0, 0.5], [2.0, 2.0], [4.0]]], [[[1.0]]]])
def test_the_descent_equals_a_twin(spark, topology):
    rows = sharding.shard_of(spark.range(2000).withColumnRenamed("id", "k"), "k", topology).collect()
    assert all(r["shard"] == twin_shard(r["k"], topology) for r in rows)


def test_sharding_law_balance_and_slots(spark, odd, nothing):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    for frame in (odd, d):
        rows = sharding.shard_documents(frame).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
            (r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in frame.collect()
        )
        slots, shard = defaultdict(list), {}
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
            assert shard.setdefault(r["doc_id"], r["shard"]) == r["shard"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r["grown_shard"] == 24 for r in rows)
    many = spark.range(48_000).withColumnRenamed("id", "k")
    count = Counter(r[0] for r in sharding.shard_of(many, "k", sharding.SHARDS_24).select("shard").collect())
    assert len(count) == 24 and all(abs(n - 2000) < 250 for n in count.values())
    assert sharding.shard_documents(nothing).count() == 0


def test_slots_of_one_id_are_spread_over_tasks(spark):
    frame = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard_documents(frame).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 20_000 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_move_only_into_or_out_of_their_subtree(spark):
    many = spark.range(20_000).withColumnRenamed("id", "k")
    tree = [[[1.0, 2.0], [1.0]], [[3.0, 1.0], [2.0, 2.0]]]
    heavier = [[[1.0, 2.0], [1.0]], [[3.0, 2.0], [2.0, 2.0]]]  # shard 4, in region 1 and its first rack, doubles
    both = sharding.shard_of(sharding.shard_of(many, "k", tree, "a"), "k", heavier, "b").select("a", "b").collect()
    moved = [(r["a"], r["b"]) for r in both if r["a"] != r["b"]]
    assert moved and all(b >= 3 for _, b in moved)  # into the region only
    assert all(b in (3, 4) for a, b in moved if a >= 3)  # within the region only into the rack
    assert all(b == 4 for a, b in moved if a == 3) and not any(a == 4 for a, _ in moved)  # within the rack only into the shard
    count = Counter(r["a"] for r in both)
    for s, w in enumerate((1, 2, 1, 3, 1, 2, 2)):
        assert abs(count[s] - 20_000 * w / 12) < 0.1 * 20_000 * w / 12 + 60


# -- near-duplicates


def brute_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def check_components(frame):
    fp = [(r["doc_id"], brute_fingerprint(r["text"])) for r in frame.collect()]
    root = brute_components(sorted({f for _, f in fp}))
    least = {}
    for i, f in fp:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    got = Counter(tuple(r) for r in simhash.near_duplicates(frame).collect())
    assert got == Counter((i, f"{f:016x}", least.get(root[f])) for i, f in fp)


def test_near_duplicates_equal_brute_force(spark, odd, nothing):
    check_components(odd)
    check_components(table(spark, "/root/testdata/sf0.01", "documents"))
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("distance", [0, 2, 4, 7, 9])
def test_links_at_other_distances(spark, distance):
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 1 << 62, 8)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 11))) for c in centre for _ in range(12)})
    signed = {f: (f + (1 << 63)) % (1 << 64) - (1 << 63) for f in fps}
    frame = spark.createDataFrame([(f,) for f in signed.values()], "fp long")
    got = {r["node"]: r["root"] for r in simhash.connected_components(simhash.links(frame, distance)).collect()}
    want = brute_components(fps, distance)
    groups, found = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[want[f]].add(f)
        found[got.get(signed[f], signed[f])].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))
    with pytest.raises(ValueError):
        simhash.links(frame, 12)


@pytest.mark.parametrize("hot", [4096, 20])
def test_links_of_dense_fingerprints(spark, hot):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 62, 12)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 7))) for c in centre for _ in range(60)}
    fps = sorted((f + (1 << 63)) % (1 << 64) - (1 << 63) for f in fps)  # signed
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.connected_components(simhash.links(frame, hot=hot)).collect()}
    want = brute_components([f % (1 << 64) for f in fps])
    groups, found = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[want[f % (1 << 64)]].add(f)
        found[got.get(f, f)].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_chain_of_components(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = simhash.connected_components(edges).collect()
    assert len(rows) == 300 and {r["root"] for r in rows} == {0}


# -- queries and pipeline


@pytest.mark.parametrize("name", QUERIES)
def test_queries_run_on_the_small_tables(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline as p

    docs = table(spark, sf_dir, "documents").cache()
    rows = {r["doc_id"]: r for r in docs.collect()}
    first = p.identify_language(spark, docs, sf_dir)
    assert first.columns == docs.columns and first.count() >= 0.99 * len(rows)
    second = p.apply_quality_rules(spark, first, sf_dir)
    left = {r["doc_id"]: r for r in first.collect()}
    every = quality.BASE | quality.RULES
    want = {i for i, r in left.items() if quality.verdict(quality.Text(r["text"]), list(every), every) is None}
    assert {r["doc_id"] for r in second.collect()} == want
    third = p.drop_near_duplicates(spark, second, sf_dir)
    fp = {i: brute_fingerprint(rows[i]["text"]) for i in want}
    root = brute_components(sorted(set(fp.values())))
    least = {}
    for i, f in fp.items():
        least[root[f]] = min(least.get(root[f], i), i)
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(least.values())
    fourth = p.mix_to_targets(spark, third, sf_dir)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(third).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in fourth.collect()) == Counter(copies) and fourth.columns == docs.columns
    last = p.pack_sequences(spark, fourth, sf_dir)
    assert last.agg(F.sum("length")).first()[0] == fourth.select("doc_id").join(last.groupBy("doc_id").agg(F.max("doc_tokens").alias("n")), "doc_id").agg(F.sum("n")).first()[0]


def test_pipeline_stages_take_odd_rows(spark, odd, nothing, sf_dir):
    import corpus_pipeline as p

    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (plain, plain.limit(0)):
        for name, stage in p.STAGES:
            out = stage(spark, frame, sf_dir)
            assert out.columns == frame.columns or name == "packing"
            out.count()


def test_near_duplicates_keep_each_text_of_shared_and_null_ids(spark, sf_dir):
    import corpus_pipeline as p

    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    ids = [(None, 0), (None, 1), (7, 2), (7, 3), (None, 2), (8, 3), (9, 4), (9, 4), (9, 4), (None, 0)]
    frame = spark.createDataFrame([(i, text(k), "en", f"s{n % 2}", 1) for n, (i, k) in enumerate(ids)], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter([(None, text(0)), (None, text(1)), (7, text(2)), (7, text(3)), (9, text(4))])
    first = p.drop_near_duplicates(spark, frame, sf_dir).collect()
    assert Counter((r["doc_id"], r["text"]) for r in first) == want
    assert sorted(map(str, first)) == sorted(map(str, p.drop_near_duplicates(spark, frame.repartition(5), sf_dir).collect()))


def test_mixing_stage_takes_rows_and_not_ids(spark, sf_dir):
    import corpus_pipeline as p

    text = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(None if k % 2 else 5, text(k, 10 + k % 3), "en", f"s{k % 4}", k) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = p.mix_to_targets(spark, frame, sf_dir)
    assert out.columns == frame.columns
    got = Counter(r["text"] for r in out.collect())
    size = {f"s{k}": sum(10 + j % 3 for j in range(200) if j % 4 == k) for k in range(4)}
    taken = Counter()
    for k in range(200):
        assert got[text(k, 10 + k % 3)] <= 3
        taken[f"s{k % 4}"] += got[text(k, 10 + k % 3)] * (10 + k % 3)
    target = brute_targets(size)
    assert all(abs(taken[s] - target[s]) <= 7 for s in size)

"""Operator 11, URL filters: a blocked Bloom filter before an exact hash join.

1. ``parse_urls``: host, path and canonical form of each URL. Only ids and URLs are read.
2. The list holds rules (host and path prefix, allow or block) and canonical URLs
   (block), each as one key. ``bloom_blocks`` makes the filter: 512-bit blocks of
   eight words, one bit a word, as a table of one row a block.
3. A URL asks for its canonical form and, of its host's endings and its path's
   beginnings, for those of the sizes that rules have. Keys whose eight bits are set are
   possible hits and go to the shared folder; all others end there.
4. The distinct keys of possible hits, with their numbers, meet the list in an exact
   hash join, which removes false positives. Real keys that very many URLs
   share (at most ``MAX_HOT`` by construction) are broadcast, the others shuffled.
5. Of a page's real keys the longest rule decides; without one, a listed URL is blocked
   and any other allowed.

The filter has ``bits_per_key`` bits a key up to ``max_blocks`` blocks (16 MB of words, so that it
can be broadcast whatever the list's length). A longer list lets more false
positives through to the join, which gives the same rows.

Canonical form: no scheme, user, default port or fragment; host in lower case (A to Z) without ``www.``;
no slash at the path's end; parameters sorted, without empty and tracking ones.

Defined cases: null URLs and those without ``://`` have empty host and path, fit no rule and are
never listed, so they are allowed; very long URLs are taken whole; of rules of one length the longer
host wins; a rule given with both verdicts blocks; rules without a host are left out;
repeated rows and null ids are judged each for themselves; extra columns are ignored; an empty
list allows all; an empty table gives no row.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalspark.llm.common import materialise

ALLOW, BLOCK = "allow", "block"
#: Parameters that don't change a page.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"
BITS_PER_KEY, MAX_BLOCKS = 12, 1 << 18
#: Possible hits of one key from which it is broadcast, and how many such keys there can be.
HOT, MAX_HOT = 100_000, 10_000
_WORDS = [f"w{i}" for i in range(8)]


def _rest(url: Column) -> Column:
    """What follows the first ``://``, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """The form under which URLs of one page are equal; null where there is none."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^[^@]*@", ""), ":(80|443)$", "")
    named = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(named, lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(_rest(url).isNotNull(), F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", ""), query))


def parse_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(row, id, host, path, canonical)`` of each page."""
    url = F.col(url_col)
    return pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical_url(url).alias("canonical"))


def list_entries(rules: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``(kind, key, verdict, labels, path_length)``, one row a key: kind 0 a canonical URL, kind 1 a rule."""
    bare = F.coalesce("path", F.lit(""))
    ruled = rules.where("host != ''").select(
        F.lit(1).alias("kind"), F.concat("host", bare).alias("key"), F.coalesce("verdict", F.lit(BLOCK)).alias("verdict"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length(bare).alias("path_length"),
    )
    urls = listed.select(F.lit(0).alias("kind"), canonical_url(F.col(url_col)).alias("key"), F.lit(BLOCK).alias("verdict"), F.lit(0).alias("labels"), F.lit(0).alias("path_length"))
    # 'block' comes after 'allow', so the greater of two verdicts blocks
    return ruled.unionByName(urls).where("key is not null").groupBy("kind", "key").agg(F.max("verdict").alias("verdict"), F.first("labels").alias("labels"), F.first("path_length").alias("path_length"))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), "kind", "key"), F.lit(blocks)).alias("block")


def _bits() -> list[Column]:
    """The bit of each of the eight words: six bits of the hash pick one of 64."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(kind, key), {6 * i}) & 63 as int))").alias(w) for i, w in enumerate(_WORDS)]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """``(block, w0 .. w7)``: the filter of ``(kind, key)`` rows."""
    return keys.select(_block(blocks), *_bits()).groupBy("block").agg(*(F.bit_or(w).alias(w) for w in _WORDS))


def possible_hits(asked: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``asked`` (with ``kind`` and ``key``) that the filter lets through; ``bloom`` is broadcast."""
    probe = asked.select("*", _block(blocks), *(b.alias(f"b{i}") for i, b in enumerate(_bits())))
    found = probe.join(F.broadcast(bloom), "block")
    for i, w in enumerate(_WORDS):
        found = found.where(F.col(w).bitwiseAND(F.col(f"b{i}")) != 0)
    return found.select(asked.columns)


def flagged(asked: DataFrame, bloom: DataFrame, blocks: int, name: str) -> DataFrame:
    """``asked`` (with ``kind`` and ``key``, which go) and whether the filter lets a row through; ``bloom`` is broadcast."""
    kept = [c for c in asked.columns if c not in ("kind", "key")]
    found = asked.select(*kept, _block(blocks), *(b.alias(f"b{i}") for i, b in enumerate(_bits()))).join(F.broadcast(bloom), "block", "left")
    hit = reduce(lambda a, b: a & b, (F.col(w).bitwiseAND(F.col(f"b{i}")) != 0 for i, w in enumerate(_WORDS)))
    return found.select(*kept, F.coalesce(hit, F.lit(False)).alias(name))


def blocks_for(keys: int, bits_per_key: int = BITS_PER_KEY, max_blocks: int = MAX_BLOCKS) -> int:
    return max(1, min(max_blocks, -(-keys * bits_per_key // 512)))


def asked_keys(parsed: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """``(row, kind, key, host_length)``: the canonical URL, and host endings of so many labels with path beginnings of such lengths."""
    own = F.when(F.col("canonical").isNotNull(), F.struct(F.lit(0).alias("kind"), F.col("canonical").alias("key"), F.lit(0).alias("host_length")))
    labels, asked = F.size(F.split("host", r"\.")), [own]
    for n, length in sizes:
        ending = F.substring_index("host", ".", -n)
        key = F.concat(ending, F.substring("path", 1, length)) if length else ending
        fits = (labels >= n) & (F.length("path") >= length) & (F.col("host") != "")
        asked.append(F.when(fits, F.struct(F.lit(1).alias("kind"), key.alias("key"), F.length(ending).alias("host_length"))))
    return parsed.select("row", F.explode(F.array_compact(F.array(*asked))).alias("q")).select("row", "q.*")


def real_hits(hits: DataFrame, entries: DataFrame, hot: int = HOT, max_hot: int = MAX_HOT) -> DataFrame:
    """Possible hits whose key is on the list, with the list's verdict."""
    keys = ["kind", "key"]
    counts = hits.groupBy(*keys).count()
    real = materialise(counts.join(entries.select(*keys, "verdict"), keys), "real-keys")
    total = real.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    bound = max(hot, total // max_hot)  # fewer than max_hot keys can have more
    many = real.where(F.col("count") > bound).select(*keys, "verdict")
    few = real.where(F.col("count") <= bound).select(*keys, "verdict")
    often = hits.join(F.broadcast(many), keys)
    seldom = hits.join(F.broadcast(many), keys, "left_anti").join(few, keys)
    return often.unionByName(seldom)


def filter_urls(
    pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url",
    bits_per_key: int = BITS_PER_KEY, max_blocks: int = MAX_BLOCKS, hot: int = HOT,
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of each page.

    ``rules``: ``(host, path, verdict)``; a rule fits its host and all subdomains where the path starts with
    the rule's. ``listed``: a table with a column ``url``.
    """
    parsed = materialise(parse_urls(pages, id_col, url_col), "urls")
    entries = materialise(list_entries(rules, listed), "url-list")
    n = entries.count()
    blocks = blocks_for(n, bits_per_key, max_blocks)
    # as many as rules differ in labels and path lengths
    sizes = sorted((r["labels"], r["path_length"]) for r in entries.where("kind = 1").select("labels", "path_length").distinct().collect())
    hits = materialise(possible_hits(asked_keys(parsed, sizes), bloom_blocks(entries, blocks), blocks), "url-hits")
    found = real_hits(hits, entries, hot=hot)
    longest = F.max(F.struct("kind", F.length("key").alias("length"), "host_length", "key", "verdict")).alias("best")
    best = found.groupBy("row").agg(longest).select("row", F.when(F.col("best.kind") == 1, F.col("best.key")).alias("rule"), "best.verdict")
    judged = parsed.join(best, "row", "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"))

"""Queries of the training-data operators over the driver's tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalspark.llm import html, language, media, mixing, packing, quality, resampling, sharding, simhash, tokens, urls, warc, whitening
from shoalspark.llm.common import table

#: Vocabulary files; the operators take their path as a parameter.
WORD_PIECES, BYTE_PIECES = "word_bpe_49k.json", "byte_bpe_50k.json"

#: Rules of the URL filter, and words of hosts whose URLs make the list.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LISTED_HOSTS = "(^|[.-])(adult|bets|casino|pills|porn|spam)([.-]|$)"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.decode_media(media.encode_media(table(spark, sf_dir, "documents"))).drop("error")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_cascade(table(spark, sf_dir, "documents")).drop("rejected_by")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(WORD_PIECES))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", (language.fold() == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_PIECES))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf_dir, "pages")).where(F.col("kind") == "record")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    listed = pages.where(urls.host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    return urls.filter_urls(pages, rules, listed)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_media_columns, op2_quality_rules, op3_token_counts, op4_language_id, op5_html_extraction, op6_packing, op7_mixing, op8_warc, op9_sharding, op10_simhash,
        op11_url_filters, op12_importance_resampling, op13_embedding_whitening,
    )
}

_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL = {
    "op2_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
        w AS (SELECT r, regexp_extract_all(t, {_WORD}) AS w FROM d),
        win AS (SELECT r, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 6)),
        rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
        cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
        lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_WORD})),
        dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines FROM lines GROUP BY r),
        b AS (SELECT d.doc_id, d.t, w.w, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words,
                len(regexp_extract_all(d.t, '[A-ZÀ-ÖØ-Þ]')) AS upper_n, len(regexp_extract_all(d.t, '[a-zß-öø-ÿ]')) AS lower_n,
                len(list_filter(w.w, lambda x: regexp_matches(x, '\p{{L}}'))) AS lettered, length(d.t) - length(replace(d.t, '!', '')) AS marks
              FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN dup USING (r)),
        v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 16 * n_words AND 2 * n_dup_lines <= n_lines
               AND 10 * upper_n <= 3 * (upper_n + lower_n) AND 2 * lettered >= n_words AND 4 * marks <= n_words AS kept
        FROM v""",
    "op8_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT h, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
                max(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id < first THEN first END AS refers_to
        FROM p JOIN f USING (h)""",
    "op11_url_filters": r"""
        WITH r AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        u AS (SELECT page_id, r, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
                list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))) AS query FROM r),
        c AS (SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
                || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical FROM u),
        listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|[.-])(adult|bets|casino|pills|porn|spam)([.-]|$)')),
        rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        best AS (SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
                FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) THEN 'block' END, 'allow') AS verdict
        FROM c LEFT JOIN best USING (r)""",
}

"""The queries that apply the operators of this package to their whole tables, and SQL for those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, licenses, mixing, near_dups, ngram_ratio, periodic_runs, prefix_trie, repeated_windows, revisits, secret_scan, token_counts, url_filter, weak_quality
from threadloom.llm.common import table

# The rules of the URL query.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Sites of no use for training, whatever the path.
BLOCKED_SITES = ("adult-x.example.com", "ads-track.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def warc_records(pages: DataFrame) -> DataFrame:
    """Two captures of each page: the response, and a later not-modified answer.

    Pages carry no capture times or headers, so these follow from the page's
    id and content: every seventh answer names another ETag, every fifth has
    only a date.
    """
    tag, i = F.md5("html"), F.col("page_id")
    date = F.concat(F.lit("day "), (i % 365).cast("string"))
    common = ["url", F.octet_length("html").cast("bigint").alias("payload_length"), tag.alias("payload_digest"), date.alias("last_modified")]
    one = F.struct(
        (2 * i).alias("record_id"),
        (10 * i).alias("captured_at"),
        F.lit(200).alias("status"),
        tag.alias("etag"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"),
            F.lit("Date"), F.concat(F.lit("t"), (10 * i).cast("string")), F.lit("Server"), F.lit("origin"),
        ).alias("headers"),
    )
    two = F.struct(
        (2 * i + 1).alias("record_id"),
        (10 * i + 5 + 1000 * (i % 7)).alias("captured_at"),
        F.lit(304).alias("status"),
        F.when(i % 5 == 0, F.lit(None).cast("string")).when(i % 7 == 1, F.lit("other")).otherwise(F.concat(F.lit("W/"), tag)).alias("etag"),
        F.create_map(
            F.lit("Date"), F.concat(F.lit("t"), (10 * i + 5).cast("string")), F.lit("Content-Length"), F.lit("0"),
            F.lit("Cache-Control"), F.lit("max-age=60"),
        ).alias("headers"),
    )
    both = pages.select(*common, F.explode(F.array(one, two)).alias("c"))
    return both.select("c.*", "url", "payload_length", "payload_digest", "last_modified")


def op2_revisits(spark: SparkSession, folder: str) -> DataFrame:
    found = revisits.resolve_revisits(warc_records(table(spark, folder, "pages")))
    return found.withColumn("headers", revisits.header_text(F.col("headers")))


OP2_SQL = r"""
    WITH bare AS (
        SELECT page_id, html, url,
            regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '(?s)#.*$', '') AS b
        FROM pages
    ), parts AS (
        SELECT *,
            regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g') AS host,
            regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
            list_sort(list_filter(string_split(regexp_extract(b, '(?s)^[^?]*\?(.*)$', 1), '&'),
                lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))) AS kept
        FROM bare
    ), named AS (
        SELECT page_id, host || CASE WHEN path = '' THEN '/' ELSE path END
                || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url,
            md5(html) AS tag, strlen(html) AS n, 'day ' || (page_id % 365) AS modified
        FROM parts
    ), revisit AS (
        SELECT 2 * page_id + 1 AS record_id, canonical_url, 10 * page_id + 5 + 1000 * (page_id % 7) AS captured_at,
            CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 1 THEN 'other' ELSE tag END AS etag, modified, page_id
        FROM named
    ), refs AS (
        SELECT v.*, f.page_id AS f, f.tag AS f_tag, f.n AS f_n, f.modified AS f_modified
        FROM revisit v ASOF LEFT JOIN (SELECT *, 10 * page_id AS at FROM named) f
            ON v.canonical_url = f.canonical_url AND v.captured_at > f.at
    ), checked AS (
        SELECT *, CASE WHEN f IS NULL THEN NULL WHEN etag IS NOT NULL THEN 'etag' WHEN modified IS NOT NULL THEN 'last-modified' END AS validator,
            CASE WHEN f IS NULL THEN false WHEN etag IS NOT NULL THEN etag = f_tag ELSE coalesce(modified = f_modified, false) END AS resolved
        FROM refs
    )
    SELECT record_id, canonical_url, captured_at, 2 * f AS refers_to, 10 * f AS refers_at, validator, resolved,
        CASE WHEN resolved THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || f_n || chr(10) || 'content-type: text/html'
            || chr(10) || 'date: t' || (10 * page_id + 5) || chr(10) || 'server: origin' END AS headers,
        CASE WHEN resolved THEN f_tag END AS payload_digest, CASE WHEN resolved THEN f_n END AS payload_length
    FROM checked"""


def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, folder, "documents"))


def op5_weak_quality(spark: SparkSession, folder: str) -> DataFrame:
    return weak_quality.quality(table(spark, folder, "documents"))


def op6_ngram_ratio(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").filter("quality = 1 AND toxic = 0")
    return ngram_ratio.quality_rules(table(spark, folder, "documents"), labels)


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), "contaminated",
        "longest_words", "longest_at", "longest_item",
    )


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    more = [(site, "", "block") for site in BLOCKED_SITES]
    return url_filter.filter_urls(table(spark, folder, "pages"), URL_RULES, more)


OP8_SQL = f"""
    WITH cut AS (
        SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
        SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{url_filter.UPPER.decode()}', '{url_filter.LOWER.decode()}') AS host,
            regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
        FROM cut
    ), rules(h, p, v) AS (VALUES {", ".join(map(str, URL_RULES))}),
    fitting AS (
        SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS r
        FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    ), listed AS (
        SELECT DISTINCT page_id FROM parts JOIN (VALUES {", ".join(f"('{s}')" for s in BLOCKED_SITES)}) s(site)
            ON host = site OR ends_with(host, '.' || site)
    )
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN listed.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts LEFT JOIN (SELECT * FROM fitting WHERE r = 1) f USING (page_id) LEFT JOIN listed USING (page_id)"""


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op10_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, folder, "documents"), size=4)


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefix_trie.numbered_turns(table(spark, folder, "conversations"))
    conv = F.col("conv_id")
    return prefix_trie.trie_nodes(*prefix_trie.share_openings(turns, F.crc32(conv.cast("string")) % 4, 3, conv - conv % 20))


def _crc_steps(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


OP11_SQL = f"""
    WITH ordered AS (
        SELECT conv_id AS c, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), convs AS (
        SELECT c, n, c - c % 20 AS base, xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda a, b: xor(a >> 8, {[_crc_steps(b) for b in range(256)]}[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
        FROM (SELECT c, count(*) AS n FROM ordered GROUP BY c)
    ), rebuilt AS (
        SELECT v.c, o.pos AS i, said, words FROM convs v JOIN ordered o ON o.c = v.base AND o.pos < v.h
        UNION ALL
        SELECT v.c, o.pos - v.h + least(v.h, coalesce(b.n, 0)), said, words
        FROM convs v JOIN ordered o ON o.c = v.c AND o.pos >= v.h LEFT JOIN convs b ON b.c = v.base
    ), paths AS (
        SELECT c, coalesce(list(sha256(said) ORDER BY i) FILTER (i IS NOT NULL), []) AS path, list(words ORDER BY i) AS words
        FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c
    ), nodes AS (
        SELECT path[1:d] AS p, d, min(c) AS conv_id, count(*) AS n, coalesce(any_value(words[d]), 0) AS w,
            sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(path) = d), '')) AS ends
        FROM paths, unnest(range(len(path) + 1)) r(d) GROUP BY ALL
    ), counted AS (
        SELECT nodes.*, (SELECT count(*) FROM nodes k WHERE k.d = nodes.d + 1 AND k.p[1:nodes.d] = nodes.p) AS children FROM nodes
    ), below AS (
        SELECT p[1:k] AS p, count(*) FILTER (children = 0) AS leaves, sum((n - 1) * w)::BIGINT AS saved
        FROM counted, unnest(range(d + 1)) r(k) GROUP BY ALL
    )
    SELECT nodes.conv_id, nodes.d AS depth, up.conv_id AS parent_conv_id, nodes.n AS n_convs, nodes.children AS n_children,
        leaves AS n_leaves, saved AS saved_tokens, nodes.ends AS ends_sha256
    FROM counted nodes JOIN below USING (p) LEFT JOIN nodes up ON nodes.d > 0 AND up.p = nodes.p[1:nodes.d - 1]"""


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; one text in ten goes on with a stretch of its own words, repeated to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(F.col("_h") / 10), F.size("_words")
    some = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_words"))
    some = some.withColumn("_a", (g % F.greatest(n, F.lit(1))).cast("int"))
    some = some.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    times = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), times))
    rebuilt = F.array_join(F.slice(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), F.lit(1), n), " ")
    return some.select("doc_id", F.when(n > 0, rebuilt).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeated_tails(table(spark, folder, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    ended = F.transform(lines, lambda line: F.concat(line, F.lit("\n")))
    found = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(ended, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_repeated_windows(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_windows.repeated_windows(table(spark, folder, "documents"))
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.length)
    return found.select("doc_id", "n_bytes", total.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_revisits, op3_licenses, op4_secrets, op5_weak_quality,
        op6_ngram_ratio, op7_decontamination, op8_url_filter, op9_mixing, op10_near_dups,
        op11_prefix_trie, op12_periodic_runs, op13_repeated_windows,
    )
}
SQL: dict[str, str] = {"op2_revisits": OP2_SQL, "op8_url_filter": OP8_SQL, "op11_prefix_trie": OP11_SQL}

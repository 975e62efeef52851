"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgate.llm import codes, decontaminate, hard_negatives, line_dedup, mixing, packing, pivots, quality, sharding, simhash, suffix_dedup, url_templates, warc
from snapgate.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query()
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards by the law ``rows``; the digests are those of the shards' texts."""
    return sharding.shuffle_into_shards(table(spark, folder, "documents"), 40).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32("text").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query()
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.balance(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


@query()
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that an earlier line matches, as a digest."""
    made = line_dedup.without_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document by a network trained without the held-out labels."""
    docs = table(spark, folder, "documents")
    network = quality.fit(docs, table(spark, folder, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), network)
    return scored.select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query()
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that occur twice, as a digest."""
    made = suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query()
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the benchmark items that occur in them; clean documents give no row."""
    found = decontaminate.occurrences(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "edits")


@query()
def op8_pivots(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    return pivots.near_vectors(table(spark, folder, "embeddings"))


_WARC_SQL = r"""
WITH page AS (
  SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS html,
    md5(concat_ws('|', 'response', coalesce(page_id::VARCHAR, ''), coalesce(url, ''))) AS d FROM pages),
response AS (
  SELECT page_id, uri, html,
    '<urn:uuid:' || concat_ws('-', d[1:8], d[9:12], d[13:16], d[17:20], d[21:32]) || '>' AS refers_to,
    regexp_extract(uri, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS origin,
    coalesce(nullif(regexp_extract(uri, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/(?:[^?#]*/)?)', 1), ''), '/') AS folder,
    regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS hrefs,
    regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1) AS title,
    regexp_extract(html, '(?i)<html\b[^>]*?\blang\s*=\s*"([^"]*)"', 1) AS language,
    regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>'
      || '|<template\b.*?</template\s*>|<title\b.*?</title\s*>', ' ', 'g'),
      '(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form'
      || '|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)'
      || '\b[^>]*>', chr(10), 'g'),
      '<[/!?a-zA-Z][^>]*>', '', 'g') AS shown
  FROM page),
decoded AS (
  SELECT *, list_transform([title, shown] || hrefs, lambda t: string_split(t, '&')[1] || array_to_string(
    list_transform(string_split(t, '&')[2:], lambda s: coalesce(
      CASE regexp_extract(s, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);', 1)
        WHEN 'amp' THEN '&' WHEN 'lt' THEN '<' WHEN 'gt' THEN '>' WHEN 'quot' THEN '"' WHEN 'apos' THEN chr(39)
        WHEN 'nbsp' THEN ' ' WHEN 'copy' THEN '©' WHEN 'reg' THEN '®' WHEN 'middot' THEN '·' END
      || s[instr(s, ';') + 1:], '&' || s)), '')) AS t
  FROM response),
folded AS (
  SELECT *, list_transform([regexp_replace(t[1], chr(10), ' ', 'g'), t[2]], lambda x: regexp_replace(regexp_replace(
    regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'),
    '^[ \n]+|[ \n]+$', '', 'g')) AS f,
    list_transform(t[3:], lambda x: CASE
      WHEN regexp_matches(x, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN x
      WHEN prefix(x, '//') THEN regexp_extract(uri, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || x
      WHEN prefix(x, '/') THEN origin || x
      WHEN prefix(x, '#') OR prefix(x, '?') THEN regexp_extract(uri, '^([^?#]*)', 1) || x
      ELSE origin || folder || x END) AS outlinks
  FROM decoded),
record AS (
  SELECT page_id, refers_to, uri, html, outlinks, 'conversion' AS record_type,
    'text/plain; charset=utf-8' AS content_type, f[2] AS block FROM folded
  UNION ALL
  SELECT page_id, refers_to, uri, html, outlinks, 'metadata', 'application/warc-fields', array_to_string(
    ['source-header: HTTP/1.1 200 OK', 'source-header: Content-Type: text/html; charset=utf-8',
     'source-header: Content-Length: ' || octet_length(encode(html)), 'title: ' || f[1], 'language: ' || language]
    || list_transform(outlinks, lambda x: 'outlink: ' || x), chr(13) || chr(10)) || chr(13) || chr(10)
  FROM folded),
named AS (SELECT *, md5(record_type || '|' || refers_to) AS d FROM record)
SELECT page_id, record_type,
  '<urn:uuid:' || concat_ws('-', d[1:8], d[9:12], d[13:16], d[17:20], d[21:32]) || '>' AS record_id,
  refers_to, uri AS target_uri, content_type, octet_length(encode(block))::BIGINT AS content_length,
  'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha256(html) AS payload_digest,
  len(outlinks)::INT AS link_count
FROM named
"""


@query(_WARC_SQL)
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and conversion records of every page, blocks as digests."""
    made = warc.derivatives(warc.responses(table(spark, folder, "pages")))
    return made.drop("date", "block")


# The tree of paths, to the depth at which the table's longest path ends.
_URL_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule
  FROM cut),
labels AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said
  FROM fits),
paths AS (
  SELECT host, path, count(*) AS pages, count(*) FILTER (said = 'allow') AS good, count(said) AS labelled,
    list_filter(string_split(path, '/'), lambda s: s <> '') AS segments
  FROM labels GROUP BY host, path),
tree AS (
  SELECT 0 AS level, host, path, pages, segments, '' AS template FROM paths
  UNION ALL
  SELECT level + 1, host, path, pages, segments, template || CASE
      WHEN segment IS NULL THEN ''
      WHEN regexp_matches(segment, '[0-9]') OR (children > 8 AND children > 0.5 * total)
      THEN '/*' || regexp_extract(segment, '(\.[A-Za-z]+)$', 1)
      ELSE '/' || segment END
  FROM (
    SELECT *, max(child) OVER (PARTITION BY host, template) AS children,
      sum(CASE WHEN segment IS NOT NULL THEN pages END) OVER (PARTITION BY host, template) AS total
    FROM (
      SELECT *, dense_rank() OVER (PARTITION BY host, template, segment IS NULL ORDER BY segment)
        * (segment IS NOT NULL)::INT AS child
      FROM (SELECT *, segments[level + 1] AS segment FROM tree)))
  WHERE level < (SELECT max(len(segments)) FROM paths)),
ended AS (SELECT * FROM tree WHERE level = (SELECT coalesce(max(len(segments)), 0) FROM paths)),
own AS (
  SELECT e.host, template, sum(good)::DOUBLE AS good, sum(labelled)::DOUBLE AS labelled
  FROM ended e JOIN paths p ON e.host = p.host AND e.path = p.path GROUP BY ALL),
hosts AS (
  SELECT *, sum(good) OVER (PARTITION BY host) AS host_good,
    sum(labelled) OVER (PARTITION BY host) AS host_labelled,
    CASE WHEN sum(labelled) OVER () > 0 THEN sum(good) OVER () / sum(labelled) OVER () ELSE 1.0 END AS prior
  FROM own),
tested AS (
  SELECT *, CASE
    WHEN labelled = 0 OR host_labelled = labelled OR host_good = 0 OR host_good = host_labelled THEN false
    ELSE (good / labelled - (host_good - good) / (host_labelled - labelled)) ** 2
      / (host_good / host_labelled * (1 - host_good / host_labelled)
         * (1 / labelled + 1 / (host_labelled - labelled))) > 3.84 END AS differs
  FROM hosts),
judged AS (
  SELECT host, template, CASE WHEN differs THEN (good + 2.0 * prior) / (labelled + 2.0)
    ELSE (sum(good) FILTER (NOT differs) OVER (PARTITION BY host) + 2.0 * prior)
      / (sum(labelled) FILTER (NOT differs) OVER (PARTITION BY host) + 2.0) END AS purity
  FROM tested)
SELECT page_id, l.host, l.path, rule,
  coalesce(said, CASE WHEN purity >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict, e.template
FROM labels l JOIN ended e ON l.host = e.host AND l.path = e.path
JOIN judged j ON e.host = j.host AND e.template = j.template
"""


@query(_URL_SQL)
def op10_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict of every page."""
    return url_templates.judge(table(spark, folder, "pages")).select(
        "page_id", "host", "path", "rule", "verdict", "template")


@query()
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 4096 tokens."""
    return packing.packed(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


_NEGATIVES_SQL = r"""
WITH kept AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
positive AS (
  SELECT * FROM met WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, r) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  (row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.r))::INT AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN met n ON p.anchor = n.anchor AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.r) <= 5
"""


@query(_NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every anchor and positive; a seventh of the labels is moved by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), relabel=moved)


def _codes_sql(rounds: int = 4) -> str:
    """Lloyd rounds by plain comparison with every entry, one pair of steps a round."""
    steps = [r"""
kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) AS t(p)),
book0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 256)"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS (
  SELECT r, a.p, any_value(a.x) AS x, min(struct_pack(
    d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS n
  FROM parts a JOIN book{k} b ON a.p = b.p GROUP BY r, a.p)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, n.e AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS m
    FROM near{k}, range(1, 1 + (SELECT max(len(x)) FROM parts)) AS t(i) GROUP BY ALL)
  GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)""")
    return "WITH" + ",".join(steps) + f""",
coded AS (
  SELECT r, string_agg(format('{{:02x}}', n.e), '' ORDER BY p) AS code, sum(n.d)::BIGINT AS error
  FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


@query(_codes_sql())
def op13_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every vector, with the digest of the codebooks."""
    coded, books = codes.compress(table(spark, folder, "embeddings"))
    return coded.select(F.col("key").alias("vec_id"), codes.hexadecimal("codes").alias("code"), "error",
                        "label_error", codes.books_digest(books).alias("codebooks_sha256"))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, folder)

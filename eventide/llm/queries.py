"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from eventide.llm import bpe, decontaminate, divergence, html_text, language_model, media, ngram_join, pii, prefix_trie, quality, suffix_dedup, url_rules
from eventide.llm.common import table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text becomes a stored picture and a page that shows it within the text, referring to it by digest; pages are parsed and references resolved.

    position is the picture's place among the page's items: 1 where the text's first line says something, else 0.
    """
    docs = table(spark, sf_dir, "documents")
    _, stored = media.store(docs)
    pages = media.refer(docs).select("doc_id", media.document_page(F.coalesce("text", F.lit("")), F.col("digest"), F.concat(F.col("n_bytes").cast("string"), F.lit(" bytes"))).alias("html"))
    items = media.resolve(media.interleave(pages), media.read_back(stored)).filter("kind = 'media'")
    return items.select("doc_id", F.regexp_extract("caption", "^[0-9]+", 0).cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("position").cast("long").alias("position"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs.select("doc_id", "text"), model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.extract(table(spark, sf_dir, "documents")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.apply_rules(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=False)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=False)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_benchmark_decontamination, op3_suffix_array_dedup, op4_token_counts, op5_byte_bpe, op6_quality_classifier, op7_html_extraction, op8_pii, op9_ngram_jaccard_join, op10_url_filters, op11_source_divergence, op12_language_model, op13_prefix_trie)}
ORACLE_SQL: dict[str, str] = {
    "op10_url_filters": r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fit AS (
  SELECT p.*, rhost, rpath, rverdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS place
  FROM p LEFT JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(rverdict, 'allow') AS verdict FROM fit WHERE place = 1
""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 3
), l AS (
  SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN (SELECT c.* FROM c JOIN kept USING (lang, term)) c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), p AS (
  SELECT n.lang, n.source, kept.term, coalesce(c.n, 0) AS n,
         1 + ((1000000000::HUGEINT * (coalesce(c.n, 0) + 1)::HUGEINT) // (n.total + l.v)::HUGEINT)::BIGINT AS p,
         1 + ((1000000000::HUGEINT * (kept.total + 1)::HUGEINT) // (l.total + l.v)::HUGEINT)::BIGINT AS q
  FROM n JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    "op13_prefix_trie": r"""
WITH own AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv, conv - conv % 20 AS template,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv FROM own)
), taken AS (
  SELECT c.conv, h, count(own.pos) AS m FROM c LEFT JOIN own ON own.conv = template AND own.pos <= h GROUP BY ALL
), turns AS (
  SELECT c.conv, own.pos, own.role, own.text FROM c JOIN own ON own.conv = template AND own.pos <= h
  UNION ALL
  SELECT own.conv, own.pos - h + m, own.role, own.text FROM own JOIN taken USING (conv) WHERE own.pos > h
), path AS (
  SELECT conv, pos AS depth, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv ORDER BY pos)) AS node,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns
  UNION ALL SELECT conv, 0, 'root', 0 FROM c
), ends AS (
  SELECT conv, max_by(node, depth) AS node FROM path GROUP BY conv
), hashes AS (
  SELECT node, sha256(string_agg(conv::VARCHAR, ',' ORDER BY conv)) AS ends_sha256 FROM ends GROUP BY node
), nodes AS (
  SELECT node, depth, min(conv) AS conv, count(*) AS n, any_value(words) AS words FROM path GROUP BY ALL
), kin AS (
  SELECT n.node, p.node AS above, n.depth - p.depth AS steps FROM nodes n JOIN path p ON p.conv = n.conv AND p.depth <= n.depth
), children AS (
  SELECT above AS node, count(*) AS k FROM kin WHERE steps = 1 GROUP BY ALL
), below AS (
  SELECT above AS node, sum((k IS NULL)::BIGINT)::BIGINT AS leaves, sum((n.n - 1) * n.words)::BIGINT AS saved
  FROM kin JOIN nodes n USING (node) LEFT JOIN children ON children.node = kin.node GROUP BY ALL
)
SELECT n.conv AS conv_id, n.depth, p.conv AS parent_conv_id, n.n AS n_convs, coalesce(children.k, 0) AS n_children,
       below.leaves AS n_leaves, below.saved AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN below USING (node) LEFT JOIN children USING (node) LEFT JOIN hashes USING (node)
LEFT JOIN kin ON kin.node = n.node AND steps = 1 LEFT JOIN nodes p ON p.node = kin.above
""",
}

"""Registered queries of WARC, secrets, top-k, urls and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.llm import mixing, secrets, topk, urlfilter, warc
from dqspark.llm.common import read, small_batches
from dqspark.llm.registry import query

_TEXT = "coalesce(html, '')"


def _duck_text(c: str) -> str:
    """The steps of ``warc.plain_text`` in the other engine's dialect."""
    out = f"regexp_replace({c}, '{warc.UNSEEN}', ' ', 'g')"
    out = f"regexp_replace({out}, '[\\r\\n\\t\\f ]+', ' ', 'g')"
    out = f"regexp_replace({out}, '{warc.BREAKS}', chr(10), 'g')"
    out = f"regexp_replace({out}, '{warc.TAGS}', '', 'g')"
    for entity, char in warc.ENTITIES:
        out = "replace({}, '{}', '{}')".format(out, entity, char.replace("'", "''"))
    out = f"regexp_replace({out}, ' *\\n[ \\n]*', chr(10), 'g')"
    out = f"regexp_replace({out}, ' +', ' ', 'g')"
    return f"trim({out}, ' ' || chr(10))"


def _duck_id(*parts: str) -> str:
    d = "sha256(" + " || '|' || ".join(parts) + ")"
    return (
        f"'<urn:uuid:' || {d}[1:8] || '-' || {d}[9:12] || '-8' || {d}[14:16] || '-8' || {d}[18:20] || '-' || {d}[21:32] || '>'"
    )


_CRLF = "chr(13) || chr(10)"
OP1_SQL = f"""
WITH response AS (
  SELECT page_id, coalesce(url, '') AS target_uri, {_TEXT} AS payload,
    {_duck_id("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "coalesce(url, '')")} AS refers_to,
    'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=UTF-8' || {_CRLF} || 'Content-Length: '
      || CAST(strlen({_TEXT}) AS VARCHAR) AS headers,
    {_duck_text(_TEXT)} AS text,
    {_duck_text(f"regexp_extract({_TEXT}, '(?is)<title[^>]*>(.*?)</title', 1)")} AS title
  FROM pages),
digested AS (
  SELECT *, 'sha256:' || sha256(payload) AS payload_digest,
    'sha256:' || sha256(headers || {_CRLF} || {_CRLF} || payload) AS source_block_digest
  FROM response),
both_kinds AS (
  SELECT *, 'conversion' AS record_type, 'text/plain; charset=UTF-8' AS content_type, text AS block FROM digested
  UNION ALL
  SELECT *, 'metadata', 'application/warc-fields',
    'title: ' || replace(title, chr(10), ' ') || {_CRLF}
    || 'http-header: ' || replace(headers, {_CRLF}, {_CRLF} || 'http-header: ') || {_CRLF}
    || 'source-payload-digest: ' || payload_digest || {_CRLF}
    || 'source-block-digest: ' || source_block_digest || {_CRLF}
    || 'source-length: ' || CAST(strlen(payload) AS VARCHAR) || {_CRLF}
    || 'text-length: ' || CAST(strlen(text) AS VARCHAR) || {_CRLF} FROM digested)
SELECT page_id, record_type, {_duck_id("record_type", "refers_to")} AS record_id, refers_to, target_uri,
  content_type, payload_digest AS source_payload_digest, source_block_digest,
  'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block
FROM both_kinds
"""


@query(OP1_SQL)
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    records = warc.derive(warc.responses_from_pages(read(spark, sf_dir, "pages")))
    return records.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type",
        "source_payload_digest", "source_block_digest", "block_digest", "content_length", "block",
    )


@query()
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: plain patterns and lexed assignments."""
    small_batches(spark)
    return secrets.summary(secrets.find_secrets(read(spark, sf_dir, "documents")))


OP3_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query(OP3_SQL)
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every 20th vector."""
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64)


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
OP7_SQL = """
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT page_id, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""


@query(OP7_SQL)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's address."""
    rules = spark.createDataFrame(RULES, urlfilter.RULE_SCHEMA)
    return urlfilter.filter_urls(read(spark, sf_dir, "pages"), rules)


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS size,
    md5(concat_ws('|', 'mix-1', CAST(doc_id AS VARCHAR))) AS digest FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS lim,
    1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM sources),
rated AS (
  SELECT *, (wanted - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM weighed),
goals AS (
  SELECT source, source_size, CASE WHEN rate >= lim / weight THEN lim ELSE weight * max(CASE WHEN rate < lim / weight THEN rate END) OVER () END AS target,
    greatest(1, CAST(ceil(source_size / 2000000) AS BIGINT)) AS shards FROM rated),
laid AS (
  SELECT d.*, source_size, target, CAST('0x' || digest[1:7] AS BIGINT) % shards AS shard FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
line AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY digest, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM laid),
shard AS (
  SELECT source, shard, CAST(sum(size) AS BIGINT) AS words, CAST(round(any_value(target)) AS BIGINT) AS goal FROM laid GROUP BY 1, 2 HAVING sum(size) > 0),
tried AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY words / (2 * k + 1) DESC, shard) AS place
  FROM (SELECT *, unnest(range(0, goal // 64 + 1)) AS k FROM shard)),
quota AS (SELECT source, shard, words, goal, count(*) FILTER (place <= goal // 64) AS q FROM tried GROUP BY ALL),
roomy AS (SELECT *, least(64 * q, 2 * words) AS sure, 2 * words - least(64 * q, 2 * words) AS room FROM quota),
given AS (
  SELECT *, sure + least(room, greatest(0, goal - sum(sure) OVER (PARTITION BY source)
    - coalesce(sum(room) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS give FROM roomy),
turned AS (
  SELECT source, shard, words, CAST(give AS BIGINT) // words AS times, CAST(give AS BIGINT) % words AS extra, (words + 63) // 64 AS blocks,
    CAST('0x' || md5(concat_ws('|', 'mix-1', source, CAST(shard AS VARCHAR)))[1:7] AS BIGINT) AS turn FROM given),
-- the blocks of a shard in the order of the permutation: each begins where the words of those before it end
blocks AS (
  SELECT source, shard, b, extra, least(64, words - 64 * b) AS width, ((b * 1000003) + turn) % blocks AS place
  FROM (SELECT *, unnest(range(0, blocks)) AS b FROM turned)),
cut AS (
  SELECT source, shard, 64 * b AS low, 64 * b + greatest(0, least(width, extra
    - coalesce(sum(width) OVER (PARTITION BY source, shard ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS high FROM blocks),
bits AS (
  SELECT l.digest, l.doc_id, l.source, l.shard, l.upto, l.size, sum(greatest(0, least(upto, high) - greatest(upto - size, low))) AS n
  FROM line l JOIN cut c ON l.source IS NOT DISTINCT FROM c.source AND l.shard = c.shard AND c.low < l.upto AND c.high > l.upto - l.size
  WHERE l.size > 0 GROUP BY ALL)
SELECT l.doc_id, CAST(l.size AS BIGINT) AS size, l.source_size, l.target,
  CAST(CASE WHEN l.size > 0 THEN t.times * l.size + coalesce(n, 0) ELSE 0 END AS BIGINT) AS taken
FROM line l LEFT JOIN turned t ON l.source IS NOT DISTINCT FROM t.source AND l.shard = t.shard
LEFT JOIN bits s ON l.digest = s.digest AND l.doc_id IS NOT DISTINCT FROM s.doc_id AND l.source IS NOT DISTINCT FROM s.source
  AND l.upto = s.upto AND l.size = s.size
"""


@query(OP9_SQL)
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to a mix of 150 % of all words, sources weighing 3, 1, 2."""
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long"), "target", "taken")

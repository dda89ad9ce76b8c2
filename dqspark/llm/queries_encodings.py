"""Registered queries of token counts, the manifest and vector codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dqspark.llm import merkle, tokencounts, vectorcodes
from dqspark.llm.common import read, small_batches
from dqspark.llm.registry import query

TOKENIZER = "word_bpe_49k.json"


@query()
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds 2048 tokens."""
    import public_tokenizers

    small_batches(spark)
    counted = tokencounts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


_FIELDS = " || ".join(
    f"CASE WHEN {f} IS NULL THEN '-' ELSE CAST(strlen(CAST({f} AS VARCHAR)) AS VARCHAR) || ':' || CAST({f} AS VARCHAR) END"
    for f in ("doc_id", "source", "lang", "n_chars", "{text}")
)
# CRC-32 from its definition, a bit at a time, over the digits of an id.
_BYTE = "CAST(ascii(s[{i}]) AS BIGINT)"
OP12_SQL = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
crc(doc_id, s, k, c) AS (
  SELECT doc_id, s, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL
  SELECT doc_id, s, k + 1, list_reduce(list_prepend(xor(c, CASE WHEN k % 8 = 0 THEN {_BYTE.format(i="k // 8 + 1")} ELSE 0 END), [0]),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)
  FROM crc WHERE k < 8 * length(s)),
hit AS (SELECT doc_id FROM crc WHERE k = 8 * length(s) AND xor(c, 4294967295) % 2 = 0),
leaves AS (
  SELECT doc_id, source, sha256({_FIELDS.format(text="text")}) AS leaf,
    CASE WHEN hit.doc_id IS NOT NULL THEN sha256({_FIELDS.format(text="replace(text, chr(10), '')")}) END AS altered
  FROM documents LEFT JOIN hit USING (doc_id)),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves),
up(tree, level, n, pos, h) AS (
  SELECT tree, 0, n, pos, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, (n + 2) // 3, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1
  GROUP BY tree, level, n, pos // 3),
tops AS (SELECT tree, level AS height, h AS subroot FROM up WHERE n = 1),
higher(level, n, pos, h) AS (
  SELECT 0, (SELECT count(*) FROM tops), tree - 1, subroot FROM tops
  UNION ALL
  SELECT level + 1, (n + 2) // 3, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM higher WHERE n > 1
  GROUP BY level, n, pos // 3),
top AS (SELECT level AS top_height, h AS root FROM higher WHERE n = 1),
places AS (
  SELECT tree, pos AS leaf_pos, height, subroot, root, top_height, unnest(range(height + top_height)) AS step
  FROM placed JOIN tops USING (tree), top),
ways AS (
  SELECT *, CASE WHEN step < height THEN leaf_pos // CAST(pow(3, step) AS BIGINT) ELSE (tree - 1) // CAST(pow(3, step - height) AS BIGINT) END AS own
  FROM places),
beside AS (
  SELECT a.tree, leaf_pos, step, own, u.pos, u.h FROM ways a JOIN up u ON u.tree = a.tree AND u.level = step AND u.pos // 3 = own // 3 WHERE step < height
  UNION ALL
  SELECT a.tree, leaf_pos, step, own, u.pos, u.h FROM ways a JOIN higher u ON u.level = step - height AND u.pos // 3 = own // 3 WHERE step >= height),
steps AS (
  SELECT tree, leaf_pos, step, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < own), '') AS l,
    coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > own), '') AS r
  FROM beside GROUP BY tree, leaf_pos, step),
fold(tree, leaf_pos, step, h) AS (
  SELECT tree, pos, 0, coalesce(altered, leaf) FROM placed
  UNION ALL
  SELECT f.tree, f.leaf_pos, f.step + 1, sha256(l || h || r) FROM fold f JOIN steps s USING (tree, leaf_pos, step)),
proofs AS (SELECT tree, leaf_pos, string_agg(l || r, '' ORDER BY step) AS proof FROM steps GROUP BY tree, leaf_pos)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM placed p JOIN tops USING (tree) CROSS JOIN top
JOIN fold f ON f.tree = p.tree AND f.leaf_pos = p.pos AND f.step = height + top_height
LEFT JOIN proofs q ON q.tree = p.tree AND q.leaf_pos = p.pos
"""


@query(OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and check of every document."""
    return merkle.manifest(read(spark, sf_dir, "documents")).drop("proof")


def _rounds(n: int) -> str:
    """Codebooks of n rounds, each from the one before."""
    out = ""
    for k in range(n):
        out += f"""
near{k} AS MATERIALIZED (
  SELECT vec_id, row, p, min(d * 16 + e) AS m FROM (
    SELECT vec_id, row, p, e, sum((x - c) * (x - c)) AS d FROM comps JOIN book{k} USING (p, i) GROUP BY ALL) GROUP BY ALL),
mean{k} AS (
  SELECT p, CAST(m % 16 AS BIGINT) AS e, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS c
  FROM comps JOIN near{k} USING (vec_id, row, p) GROUP BY p, m % 16, i),
book{k + 1} AS MATERIALIZED (
  SELECT p, e, i, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e, i)),"""
    return out


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
    row_number() OVER (ORDER BY vec_id, embedding) AS row
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps AS MATERIALIZED (
  SELECT vec_id, row, (j - 1) // w AS p, (j - 1) % w AS i, v[j] AS x
  FROM (SELECT vec_id, row, v, len(v) // 8 AS w, unnest(range(1, len(v) + 1)) AS j FROM kept)),
book0 AS MATERIALIZED (SELECT p, row - 1 AS e, i, x AS c FROM comps WHERE row <= 16),{_rounds(6)}
last AS (
  SELECT vec_id, row, p, min(d * 16 + e) AS m FROM (
    SELECT vec_id, row, p, e, sum((x - c) * (x - c)) AS d FROM comps JOIN book6 USING (p, i) GROUP BY ALL) GROUP BY ALL),
coded AS (
  SELECT vec_id, row, string_agg(printf('%02x', CAST(m % 16 AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error
  FROM last GROUP BY vec_id, row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM book6) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id, row)
"""


@query(OP13_SQL)
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code of every vector in 8 parts of 16 entries, with errors."""
    return vectorcodes.compress(read(spark, sf_dir, "embeddings"))

"""Conversations, similar vectors and pipe tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.functions.text import truncate
from dqspark.functions.vectors import cosine
from dqspark.operators import conversation
from dqspark.operators.pipetables import pipe_tables as cells_of
from dqspark.operators.similarity import best_match
from dqspark.queries.registry import duck_clean, duck_trim, query, table
from dqspark.values import CONTEXT_FOOTER, CONTEXT_HEADER


@query("""
SELECT conv_id, turn, role, text, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations) WHERE place <= 3
""")
def last_turns(spark, sf_dir):
    return conversation.last_turns(table(spark, sf_dir, "conversations"))


FOOTER_SQL = CONTEXT_FOOTER.replace("'", "''")


@query(f"""
WITH p AS (
  SELECT q.conv_id, q.turn, {duck_clean('q.text')} AS q, {duck_clean("coalesce(a.text, '')")} AS a
  FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  WHERE q.role = 'user'
), k AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i, q,
    CASE WHEN length(a) > 300 THEN a[:297] || '…' ELSE a END AS a FROM p
)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, '{CONTEXT_HEADER}' || chr(10)
  || string_agg('- Q' || i || ': ' || q || chr(10) || '  A' || i || ': ' || a, chr(10) ORDER BY i)
  || chr(10) || '{FOOTER_SQL}' AS context
FROM k WHERE i <= 3 GROUP BY conv_id
""")
def context_block(spark, sf_dir):
    return conversation.context_block(conversation.question_answers(table(spark, sf_dir, "conversations")))


@query(f"SELECT 'q::' || lower({duck_trim('text')}) AS turn_key, count(*) AS n_asked FROM conversations GROUP BY 1")
def cache_key(spark, sf_dir):
    return conversation.repeated_questions(table(spark, sf_dir, "conversations"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 300 THEN text[:297] || '…' ELSE text END AS short FROM documents
""")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", truncate(F.col("text"), 300).alias("short"))


CENTRES_SQL = """
WITH pos AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM pos GROUP BY 1, 2),
centre AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY 1)
"""


def _centres(vectors):
    """Mean vector per label; the list per label is as long as a vector."""
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l"))
    return listed.select("label", F.col("l.x").alias("v"))


@query(CENTRES_SQL + """
, s AS (SELECT e.vec_id, centre.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), v) AS s FROM embeddings e, centre)
SELECT vec_id, arg_max(label, s) AS label, round(max(s), 4) AS similarity FROM s WHERE s >= 0.2 GROUP BY 1
""")
def cosine_top1(spark, sf_dir):
    """Best stored entry for every vector; the entries are the mean vectors of the labels."""
    vectors = table(spark, sf_dir, "embeddings")
    found = best_match(vectors, _centres(vectors), "vec_id", "label", "embedding", "v", min_similarity=0.2)
    return found.withColumn("similarity", F.round("similarity", 4))


@query("""
WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS e, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM x a JOIN x b ON a.vec_id <> b.vec_id)
SELECT vec_id, arg_min(e, {'a': -s, 'b': e}) AS similar_vec_id, round(max(s), 4) AS similarity FROM s WHERE s >= 0.35 GROUP BY 1
""")
def cosine_top1_blocks(spark, sf_dir):
    """Most similar other vector of every vector, both sides taken as large (K4)."""
    vectors = table(spark, sf_dir, "embeddings")
    found = best_match(
        vectors, vectors, "vec_id", "vec_id", "embedding", "embedding", 0.35, skip_same_key=True, small_side=0, block_bytes=1 << 20
    )
    return found.withColumn("similarity", F.round("similarity", 4))


@query(CENTRES_SQL + """
SELECT vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), v), 4) AS similarity
FROM embeddings e JOIN centre ON centre.label = e.label
""")
def cosine_to_centre(spark, sf_dir):
    """Similarity of every vector with the mean vector of its own label."""
    vectors = table(spark, sf_dir, "embeddings")
    joined = vectors.join(_centres(vectors), "label")
    return joined.select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("v")), 4).alias("similarity"))


@query("""
WITH lines AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda l: contains(l, '|')) AS ls FROM documents
), t AS (
  SELECT doc_id, list_transform(list_filter(ls, lambda l: NOT contains(l, '---')),
    lambda l: list_transform(string_split(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '|'),
      lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g'))) AS rs
  FROM lines WHERE len(ls) >= 2
), r AS (SELECT doc_id, generate_subscripts(rs, 1) - 1 AS row_no, unnest(rs) AS r FROM t),
c AS (SELECT doc_id, row_no, generate_subscripts(r, 1) - 1 AS col_no, unnest(r) AS cell FROM r)
SELECT doc_id, CAST(row_no AS INTEGER) AS row_no, CAST(col_no AS INTEGER) AS col_no, cell FROM c
WHERE (doc_id, col_no) IN (SELECT (doc_id, col_no) FROM c WHERE row_no >= 1 AND cell <> '')
""")
def pipe_tables(spark, sf_dir):
    return cells_of(table(spark, sf_dir, "documents"), "doc_id", "text")

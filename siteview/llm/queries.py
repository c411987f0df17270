"""The corpus operators as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ctw, decontam, html_text, neardup, phrases, pii, quality, rans, repair, sharding, subword, topk, toxicity
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"), 16)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.encode(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_digest(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digest(repair.damaged(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_decontaminate, op2_personal_data, op3_quality, op4_hilbert_shards, op5_sentencepiece, op6_exact_top_k, op7_context_tree, op8_main_text, op9_near_duplicates, op10_toxicity,
        op11_token_files, op12_phrases, op13_repair, pipeline,
    )
    return {f.__name__: f for f in ops}


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

NEAR_DUPLICATE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) = 1 THEN t
    ELSE list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) END) AS g
  FROM w
), e AS (
  SELECT doc_id, unnest(g) AS h FROM s
), rare AS (  -- a pair that is alike shares one of the rarest fifth of either side's shingles, and one more
  SELECT doc_id, h FROM (
    SELECT e.doc_id, e.h, row_number() OVER (PARTITION BY e.doc_id ORDER BY f.n, e.h) AS k, count(*) OVER (PARTITION BY e.doc_id) AS m
    FROM e JOIN (SELECT h, count(*) AS n FROM e GROUP BY h) f ON e.h = f.h)
  WHERE k <= m - CAST(ceil(0.8 * m) AS BIGINT) + 1
), c AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b ON a.h = b.h AND a.doc_id < b.doc_id
), l AS (
  SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b
  WHERE 100 * len(list_intersect(x.g, y.g)) >= 80 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)))
), edge AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
), m AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m ON s.doc_id = m.doc_id
"""

PHRASES_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), suffix AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece)
), c1 AS (
  SELECT lang, w1, count(*) AS f FROM suffix GROUP BY ALL
), c2 AS (
  SELECT lang, w1, w2, count(*) AS f FROM suffix WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), c3 AS (
  SELECT lang, w1, w2, w3, count(*) AS f FROM suffix WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), size AS (
  SELECT lang, sum(f) AS n FROM c1 GROUP BY lang
), longer AS (
  SELECT lang, w1, w2, max(f) AS longest FROM (SELECT lang, w1, w2, f FROM c3 UNION ALL SELECT lang, w2, w3, f FROM c3) GROUP BY ALL
), cut AS (
  SELECT p.lang, concat(p.w1, ' ', p.w2) AS phrase, p.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM c2 p JOIN c1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN c1 y ON y.lang = p.lang AND y.w1 = p.w2
  LEFT JOIN longer o ON o.lang = p.lang AND o.w1 = p.w1 AND o.w2 = p.w2
  WHERE o.longest IS NULL OR 100 * o.longest < 50 * p.f
  UNION ALL
  SELECT p.lang, concat(p.w1, ' ', p.w2, ' ', p.w3), p.f, x.f, y.f, 1
  FROM c3 p JOIN c1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN c2 y ON y.lang = p.lang AND y.w1 = p.w2 AND y.w2 = p.w3
  UNION ALL
  SELECT p.lang, concat(p.w1, ' ', p.w2, ' ', p.w3), p.f, x.f, y.f, 2
  FROM c3 p JOIN c2 x ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2 JOIN c1 y ON y.lang = p.lang AND y.w1 = p.w3
), best AS (
  SELECT *, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cut
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM best JOIN size USING (lang)
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """The other operators learn models, hash with functions that SQL lacks or parse markup; tests/llm checks
    them against brute force, exact round trips and held-out rows."""
    return {"op6_exact_top_k": TOP_K_SQL, "op9_near_duplicates": NEAR_DUPLICATE_SQL, "op12_phrases": PHRASES_SQL}

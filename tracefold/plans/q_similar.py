"""Registered queries: embeddings, similar incidents, incident upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.operators import similar as S
from tracefold.plans import flows as FL
from tracefold.plans.registry import register
from tracefold.session import table

TOP_K = 5


@register("G3_hash_embed")
def q_hash_embed(spark, sf_dir):
    """Embedding of every bundle summary (rows-only: DuckDB has no sha512)."""
    s = FL.summaries_b(spark, sf_dir)
    e = S.hash_embedding(s, "summary")
    return e.select("bundle_id", F.size("embedding").cast("long").alias("dim"),
                    F.round(F.element_at("embedding", 1), 6).alias("v0"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v), 6).alias("vsum"))


@register("W9_top_k_similar", f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM e),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS index_id, list_dot_product(a.v, b.v) / (a.nrm * b.nrm)
    AS similarity
  FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.nrm > 0 AND b.nrm > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, index_id) AS rank
  FROM pairs WHERE similarity >= 0)
SELECT query_id, index_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= {TOP_K}""")
def q_top_k_similar(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    r = S.top_k_similar(emb.withColumnRenamed("vec_id", "query_id"), emb.withColumnRenamed("vec_id", "index_id"),
                        k=TOP_K, exclude_self=True)
    return r.select("query_id", "index_id", F.round("similarity", 6).alias("similarity"), "rank")


_UPSERT_SQL = """
WITH v1 AS (SELECT 'inc_' || CAST(vec_id AS VARCHAR) AS id, CAST(1 AS BIGINT) AS version, label,
    'incident class ' || CAST(label AS VARCHAR) AS recommended_action FROM embeddings),
v2 AS (SELECT 'inc_' || CAST(vec_id AS VARCHAR) AS id, CAST(2 AS BIGINT) AS version, (label + 1) % 10 AS label,
    'relabelled class ' || CAST((label + 1) % 10 AS VARCHAR) AS recommended_action
  FROM embeddings WHERE embedding[1] > 0),
u AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2)
SELECT id, arg_max(version, version) AS version, arg_max(label, version) AS label,
  arg_max(recommended_action, version) AS recommended_action FROM u GROUP BY id"""


@register("S5_upsert_incidents", _UPSERT_SQL)
def q_upsert_incidents(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    iid = F.concat(F.lit("inc_"), F.col("vec_id").cast("string"))
    v1 = emb.select(iid.alias("id"), F.lit(1).cast("long").alias("version"), "label",
                    F.concat(F.lit("incident class "), F.col("label").cast("string")).alias("recommended_action"))
    nl = (F.col("label") + 1) % 10
    v2 = emb.where(F.element_at("embedding", 1) > 0).select(
        iid.alias("id"), F.lit(2).cast("long").alias("version"), nl.alias("label"),
        F.concat(F.lit("relabelled class "), nl.cast("string")).alias("recommended_action"))
    return S.upsert_incidents(v1, v2)

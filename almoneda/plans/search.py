"""Queries of retrieval. Scores are rounded, as the engines' logarithms may differ in the last digit."""

from __future__ import annotations

from pyspark.sql import functions as F

from almoneda import search as R
from almoneda.plans.registry import query
from almoneda.plans.testbind import table
from almoneda.postings import Index
from almoneda.store import workspace, written
from almoneda.vectors import VectorIndex, brute_force

_TERMS = ["the", "idiot", "onre"]
_BM25 = r"""w AS (SELECT doc_id, lang, list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, lang, len(ws) AS dl, unnest(['the', 'idiot', 'onre']) AS term, unnest([len(list_filter(ws, lambda x: x = 'the')), len(list_filter(ws, lambda x: x = 'idiot')), len(list_filter(ws, lambda x: x = 'onre'))]) AS tf FROM w),
s AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w), f AS (SELECT term, count(*) AS df FROM t WHERE tf > 0 GROUP BY term),
kw AS (SELECT doc_id, lang, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM t JOIN f USING (term), s WHERE tf > 0 GROUP BY doc_id, lang)"""
_VEC = "q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), vec AS (SELECT vec_id, (1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[]))) / 2 AS score FROM embeddings, q)"


def _query_vector(spark, d):
    return table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]


@query("bm25_topk", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM kw ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def _(spark, d):
    return R.top(R.bm25(table(spark, d, "documents"), _TERMS), "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_indexed", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM kw ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def _(spark, d):
    """Half of the documents come later, as a second segment; only ranges that can hold one of the 20 are scored."""
    docs = table(spark, d, "documents")
    index = Index(spark, workspace(spark, "index")).build(docs.filter("doc_id % 2 = 0")).add(docs.filter("doc_id % 2 <> 0 OR doc_id IS NULL"))
    return index.top(_TERMS, 20).select("doc_id", F.round("score", 6).alias("score"))


@query("vector_cells", f"WITH {_VEC} SELECT vec_id, round(score, 6) AS score FROM vec ORDER BY round(score, 9) DESC, vec_id LIMIT 20")
def _(spark, d):
    """The exact best by cells: those are left out whose radius can't reach what was found."""
    index = VectorIndex(spark, workspace(spark, "cells")).build(table(spark, d, "embeddings"))
    return index.exact(_query_vector(spark, d), 20).select("vec_id", F.round("score", 6).alias("score"))


def _asked(spark, d):
    """Every vector whose id is divisible by 20 as a query to all."""
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("vector_index_topk")
def _(spark, d):
    """(query_id, rank, vec_id, score) by compressed codes of the nearest cells; `vector_index_recall` measures it."""
    return VectorIndex(spark, workspace(spark, "cells")).build(table(spark, d, "embeddings")).search(_asked(spark, d), 20)


@query("vector_index_recall", "SELECT count(*) AS queries, true AS recall_reached, true AS part_of_cells FROM embeddings WHERE vec_id % 20 = 0")
def _(spark, d):
    """Whether the 20 found of each query hold at least 0.9 of the 20 true ones, and part of the cells was looked into."""
    vectors, asked = table(spark, d, "embeddings"), written(_asked(spark, d), "asked")
    index = VectorIndex(spark, workspace(spark, "cells")).build(vectors)
    true = brute_force(vectors, asked, 20).select("query_id", "vec_id")
    hit = index.search(asked, 20).select("query_id", "vec_id", F.lit(True).alias("hit"))
    share = true.join(hit, ["query_id", "vec_id"], "left").agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") / F.count("*") >= 0.9).alias("recall_reached"))
    return share.withColumn("part_of_cells", F.lit(index.probes < index.cells))


@query("vector_topk", f"WITH {_VEC} SELECT vec_id, round(score, 6) AS score FROM vec ORDER BY round(score, 9) DESC, vec_id LIMIT 20")
def _(spark, d):
    return R.top(R.cosine(table(spark, d, "embeddings"), _query_vector(spark, d)), "vec_id", 20).select("vec_id", F.round("score", 6).alias("score"))


def _hybrid_sql(where: str) -> str:
    side = lambda name, src, key: f"{name} AS (SELECT id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS s FROM (SELECT {key} AS id, score FROM {src} ORDER BY round(score, 9) DESC, {key} LIMIT 100))"
    return f"""WITH {_BM25}, {_VEC}, p AS (SELECT doc_id FROM documents JOIN embeddings ON doc_id = vec_id {where}), kp AS (SELECT * FROM kw WHERE doc_id IN (SELECT doc_id FROM p)), vp AS (SELECT * FROM vec WHERE vec_id IN (SELECT doc_id FROM p)),
{side('a', 'kp', 'doc_id')}, {side('b', 'vp', 'vec_id')}
SELECT id, round(0.5 * coalesce(b.s, 0) + 0.5 * coalesce(a.s, 0), 6) AS score FROM a FULL JOIN b USING (id) ORDER BY round(0.5 * coalesce(b.s, 0) + 0.5 * coalesce(a.s, 0), 9) DESC, id LIMIT 20"""


def _hybrid(spark, d, lang=None):
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    both = docs.filter(F.col("lang") == lang) if lang else docs
    both = written(both.select("doc_id").join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi"), "found")
    kw = R.bm25(docs, _TERMS, both).withColumnRenamed("doc_id", "id")
    vec = R.cosine(vectors.join(both.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), _query_vector(spark, d)).withColumnRenamed("vec_id", "id")
    return R.top(R.fuse(kw, vec), "id", 20).select("id", F.round("score", 6).alias("score"))


@query("hybrid_topk", _hybrid_sql(""))
def _(spark, d):
    return _hybrid(spark, d)


@query("hybrid_filtered", _hybrid_sql("WHERE lang = 'en'"))
def _(spark, d):
    return _hybrid(spark, d, "en")


def _page_sql(offset: int) -> str:
    """A page of the full sort, both rankings scaled over all their rows."""
    side = lambda name, src, key: f"{name} AS (SELECT {key} AS id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS s FROM {src})"
    return f"""WITH {_BM25}, {_VEC}, p AS (SELECT doc_id FROM documents JOIN embeddings ON doc_id = vec_id), kp AS (SELECT * FROM kw WHERE doc_id IN (SELECT doc_id FROM p)), vp AS (SELECT * FROM vec WHERE vec_id IN (SELECT doc_id FROM p)),
{side('a', 'kp', 'doc_id')}, {side('b', 'vp', 'vec_id')}, fused AS (SELECT id, 0.5 * coalesce(b.s, 0) + 0.5 * coalesce(a.s, 0) AS score FROM a FULL JOIN b USING (id))
SELECT id, round(score, 6) AS score FROM fused ORDER BY round(score, 9) DESC, id LIMIT 20 OFFSET {offset}"""


def _page(spark, d, offset):
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    both = written(docs.select("doc_id").join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi"), "found")
    kw = R.bm25(docs, _TERMS, both).withColumnRenamed("doc_id", "id")
    vec = R.cosine(vectors.join(both.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), _query_vector(spark, d)).withColumnRenamed("vec_id", "id")
    return R.fused_page(kw, vec, 20, offset).select("id", F.round("score", 6).alias("score"))


@query("hybrid_page_first", _page_sql(0))
def _(spark, d):
    return _page(spark, d, 0)


@query("hybrid_page_deep", _page_sql(150))
def _(spark, d):
    """A page that lies beyond any hundred candidates."""
    return _page(spark, d, 150)


@query("company_search")
def _(spark, d):
    return R.search_companies(R.company_documents(table(spark, d, "customer").select(F.col("c_custkey").alias("nif"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).withColumn("nif", F.col("nif").cast("string"))), "Customer building")


@query("embed_text", r"SELECT item_id, 64 AS dims, CASE WHEN regexp_matches(text, '[\pL\pN]') THEN 1.0::DOUBLE ELSE 0.0 END AS norm FROM benchmark")
def _(spark, d):
    from almoneda.providers import embed

    out = embed(table(spark, d, "benchmark").select("item_id", F.col("text").alias("content")))
    return out.select("item_id", F.size("embedding").alias("dims"), F.round(F.sqrt(R._dot("embedding", "embedding")), 4).alias("norm"))


@query("criteria_fetch", "SELECT CAST(event_id AS VARCHAR) AS sid, CAST(props ->> '$.k' AS BIGINT) AS k, 'PUB' AS estado FROM events WHERE event_id = 7")
def _(spark, d):
    from almoneda.search import criteria_of

    stored = table(spark, d, "events").select(F.col("event_id").cast("string").alias("sid"), F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "estado": "PUB"}')).alias("criteria_json"))
    return criteria_of(stored, "7", "k long, estado string").select("sid", "criteria.k", "criteria.estado")

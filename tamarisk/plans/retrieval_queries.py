"""Retrieval: ranked lists, fusion and the seven pipelines, with benchmark items as questions and documents as corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions.text import tokens
from tamarisk.operators import evals
from tamarisk.operators.retrieve import Corpus, vector_top_k
from tamarisk.plans.chains import contexts, create_chain
from tamarisk.plans.sql import DOCS, ITEMS, PAGES, WORDS, fused, search, top
from tamarisk.sources.tables import load


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))


def _corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(_docs(spark, sf_dir), _questions(spark, sf_dir).select("query_id", tokens(F.col("text")).alias("words")))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return vector_top_k(rows.where("vec_id % 100 = 0"), rows)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).bm25(20)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).cosine(20)


def web_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(_pages(spark, sf_dir), _questions(spark, sf_dir).select("query_id", tokens(F.col("text")).alias("words"))).bm25(5)


def dual_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).lists(cosine=20, bm25=20)


def _chain(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return create_chain(name)(_questions(spark, sf_dir), _docs(spark, sf_dir), pages=_pages(spark, sf_dir))

    return run


def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = contexts(create_chain("hybrid")(_questions(spark, sf_dir), docs), docs)
    return found.select("query_id", F.char_length("context").cast("long").alias("context_chars"), F.md5("context").alias("context_md5"))


def context_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the label that an example expects is among those of the documents that the hybrid chain finds for its question. The
    expected label is the source of the document with the example's number."""
    labels = load(spark, sf_dir, "documents").select("doc_id", "source")
    expected = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key")).join(labels.withColumnRenamed("doc_id", "key"), "key")
    found = create_chain("hybrid")(_questions(spark, sf_dir), _docs(spark, sf_dir)).join(labels, "doc_id").select(F.col("query_id").alias("key"), "source")
    return evals.context_recall(expected, found, "key", "source")


_HALF = "CAST(ceil(len(ws) / 2) AS BIGINT)"
_VARIANTS = f"""
SELECT query_id * 10 + no AS query_id, ws FROM (
  SELECT query_id, 0 AS no, ws FROM ({ITEMS}) UNION ALL SELECT query_id, 1, ws[1 : {_HALF}] FROM ({ITEMS}) UNION ALL SELECT query_id, 2, ws[{_HALF} + 1 :] FROM ({ITEMS}))"""
_MULTI = f"SELECT query_id // 10 AS query_id, query_id % 10 AS list_no, doc_id, score, rank FROM ({top('cos', 5)})"
_BOTH = f"SELECT query_id, doc_id, score, rank, 0 AS list_no FROM ({top('cos', 20)}) UNION ALL SELECT query_id, doc_id, score, rank, 1 FROM ({top('bm', 20)})"
_HYDE = "SELECT item_id AS query_id, " + WORDS.format("text || ' The answer is as follows.'") + " AS ws FROM benchmark"
_ROUTED = "SELECT * FROM (" + ITEMS.replace("FROM benchmark", "FROM benchmark WHERE {0} contains(' ' || lower(text) || ' ', ' the ')") + ")"

QUERIES = {
    "vector_topk": vector_topk, "bm25_topk": bm25_topk, "cosine_topk": cosine_topk, "web_search": web_search, "dual_retrieval": dual_retrieval, "rrf_hybrid": _chain("hybrid"), "rag_naive": _chain("naive"),
    "rag_hyde": _chain("hyde"), "rag_multi_query": _chain("multi_query"), "rag_fusion": _chain("rag_fusion"), "rag_rerank": _chain("rerank"), "rag_route": _chain("route"), "context_assembly": context_assembly, "context_recall": context_recall,
}
SQL = {
    "vector_topk": """
WITH s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""",
    "bm25_topk": f"WITH {search()} {top('bm', 20)}",
    "cosine_topk": f"WITH {search()} {top('cos', 20)}",
    "web_search": f"WITH {search(PAGES)} {top('bm', 5)}",
    "dual_retrieval": f"WITH {search()} {_BOTH}",
    "rrf_hybrid": f"WITH {search()} {fused(_BOTH)}",
    "rag_naive": f"WITH {search()} {top('cos', 5)}",
    "rag_hyde": f"WITH {search(queries=_HYDE)} {top('cos', 5)}",
    "rag_multi_query": f"WITH {search(queries=_VARIANTS)} SELECT query_id, list_no AS query_no, doc_id, score, rank FROM ({_MULTI})",
    "rag_fusion": f"WITH {search(queries=_VARIANTS)} {fused(_MULTI)}",
    "rag_rerank": f"""WITH {search()}
SELECT query_id, doc_id, CAST(coverage AS DOUBLE) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, bm25 DESC, doc_id) AS rank FROM (
    SELECT c.query_id, c.doc_id, coverage, bm.score AS bm25 FROM ({top('cos', 20)}) c JOIN cov USING (query_id, doc_id) JOIN bm USING (query_id, doc_id))) WHERE rank <= 5""",
    "rag_route": f"""WITH {search(DOCS, _ROUTED.format(''))}, {search(PAGES, _ROUTED.format('NOT'), '2')}
SELECT *, 'documents' AS source FROM ({top('cos', 5)}) UNION ALL SELECT *, 'web' FROM ({top('bm2', 5)})""",
    "context_recall": f"""WITH {search()}, f AS ({fused(_BOTH)}),
r AS (SELECT DISTINCT query_id, source FROM f JOIN documents USING (doc_id)), e AS (SELECT item_id AS key, source FROM benchmark JOIN documents ON doc_id = item_id)
SELECT key, CAST(count(r.source) > 0 AS INT) AS score FROM e LEFT JOIN r ON r.query_id = e.key AND r.source = e.source GROUP BY key""",
    "context_assembly": f"""WITH {search()}, f AS ({fused(_BOTH)}),
c AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM f JOIN documents USING (doc_id) GROUP BY 1)
SELECT query_id, CAST(length(context) AS BIGINT) AS context_chars, md5(context) AS context_md5 FROM c""",
}

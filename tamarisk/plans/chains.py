"""The seven retrieval pipelines as plans over batches of questions.

A chain takes questions (query_id, text), a corpus (doc_id, text) and, where it searches the web, pages (doc_id, text); it
gives the context of each question as (query_id, doc_id, score, rank), and multi_query also query_no.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.functions.models import model
from tamarisk.functions.text import tokens
from tamarisk.operators.fuse import reciprocal_rank_fusion
from tamarisk.operators.retrieve import Corpus


def _asked(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", tokens(F.col("text")).alias("words"))


def naive(questions: DataFrame, corpus: DataFrame, **_) -> DataFrame:
    return Corpus(corpus, _asked(questions)).cosine(5)


def hyde(questions: DataFrame, corpus: DataFrame, **_) -> DataFrame:
    """Searches with a hypothetical answer; prompts still use the question."""
    return Corpus(corpus, _asked(questions.withColumn("text", model("hypothetical_answer")(F.col("text"))))).cosine(5)


def _variants(questions: DataFrame) -> DataFrame:
    expanded = _asked(questions).select("query_id", F.posexplode(model("expand_query")(F.col("words"))).alias("query_no", "words"))
    return expanded.select(F.struct("query_id", F.col("query_no").cast("long").alias("query_no")).alias("query_id"), "words")


def _each_variant(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    found = Corpus(corpus, _variants(questions)).cosine(5)
    return found.select("query_id.query_id", "query_id.query_no", "doc_id", "score", "rank")


def multi_query(questions: DataFrame, corpus: DataFrame, **_) -> DataFrame:
    """The five best of each variant, repeats kept."""
    return _each_variant(questions, corpus)


def rag_fusion(questions: DataFrame, corpus: DataFrame, **_) -> DataFrame:
    return reciprocal_rank_fusion(_each_variant(questions, corpus).withColumnRenamed("query_no", "list_no"))


def rerank(questions: DataFrame, corpus: DataFrame, **_) -> DataFrame:
    """Twenty candidates, ordered anew by the words they cover, then by BM25; five stay. score is the coverage."""
    index = Corpus(corpus, _asked(questions))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("bm25"), "doc_id")
    scored = index.ranked(cosine=20).withColumn("score", model("rerank_score")(F.col("coverage"), F.col("bm25")))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("query_id", "doc_id", "score", "rank")


def route(questions: DataFrame, corpus: DataFrame, pages: DataFrame, **_) -> DataFrame:
    """Each question goes to one retriever; source tells which."""
    routed = questions.withColumn("route", model("select_route")(F.col("text")))
    own = Corpus(corpus, _asked(routed.where("route = 'documents'"))).cosine(5).withColumn("source", F.lit("documents"))
    web = Corpus(pages, _asked(routed.where("route = 'web'"))).bm25(5).withColumn("source", F.lit("web"))
    return own.unionByName(web)


def hybrid(questions: DataFrame, corpus: DataFrame, **_) -> DataFrame:
    index = Corpus(corpus, _asked(questions))
    return reciprocal_rank_fusion(index.lists(cosine=20, bm25=20))


CHAINS: dict[str, Callable[..., DataFrame]] = {"naive": naive, "hyde": hyde, "multi_query": multi_query, "rag_fusion": rag_fusion, "rerank": rerank, "route": route, "hybrid": hybrid}


def create_chain(name: str) -> Callable[..., DataFrame]:
    if name not in CHAINS:
        raise ValueError(f"unknown chain {name}; there are {', '.join(CHAINS)}")
    return CHAINS[name]


def contexts(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, context): the documents of each question in order of rank, one after another."""
    held = found.join(corpus.select("doc_id", "text"), "doc_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text"))), lambda x: x["text"])
    return held.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("context"))


def events(found: DataFrame, questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """The event stream of each call: (call_id, seq, kind, payload), call first, then the context, then answer tokens."""
    prompt = questions.join(contexts(found, corpus), "query_id", "left").select("query_id", model("answer")(F.coalesce("context", F.lit("")), F.col("text")).alias("prompt"))
    ids = questions.select(F.col("query_id").alias("call_id"), F.lit(0).cast("long").alias("seq"), F.lit("call").alias("kind"), F.col("query_id").cast("string").alias("payload"))
    context = found.select(F.col("query_id").alias("call_id"), F.col("rank").cast("long").alias("seq"), F.lit("context").alias("kind"), F.col("doc_id").cast("string").alias("payload"))
    answer = prompt.select(F.col("query_id").alias("call_id"), F.posexplode(tokens(F.col("prompt"))).alias("seq", "payload")).select("call_id", (F.col("seq") + 1_000).cast("long").alias("seq"), F.lit("token").alias("kind"), "payload")
    return ids.unionByName(context).unionByName(answer)

"""Kept results of questions: what an unchanged question found stays good until the corpus changes where it matters.

A result is kept under a digest of chain and question, with the version of the corpus that it was found in. When the corpus has a
newer version, only the documents that differ are read (see versions): a result stays good unless one of those documents,
as it was or as it is, holds a word of the question. That is exact for chains whose scores come from single documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions.text import tokens
from tamarisk.operators.keyed_table import KeyedTable, stamped
from tamarisk.plans.chains import create_chain
from tamarisk.sources import versions
from tamarisk.sources.tables import work_dir

#: Chains whose results no other document's words change; BM25 weighs words by all documents, so its chains are not among them.
CHAINS = ("naive", "rag_fusion")
FOUND = "array<struct<doc_id:bigint,score:double,rank:bigint>>"


class AnswerCache:
    """A cache at path for the datasets of documents (doc_id, text) that are published below corpora."""

    def __init__(self, spark: SparkSession, path: str, corpora: str) -> None:
        self.spark, self.corpora = spark, corpora
        self.table = KeyedTable(spark, path, "digest", f"digest string, version long, found {FOUND}", {"version": "max", "found": "last"}, buckets=16)

    def ask(self, questions: DataFrame, chain: str, corpus: str, version: int | None = None) -> DataFrame:
        """query_id, doc_id, score, rank of questions (query_id, text) in a version of a corpus (the last one unless given), and
        cached, which tells whether the result was kept. Equal questions are asked once; a null text is an empty one."""
        if chain not in CHAINS:
            raise ValueError(f"results of {chain} depend on all documents")
        now = versions.manifest(self.spark, self.corpora, corpus, version)["version"]
        folder = work_dir(self.spark, "answers")

        def stored(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        text = F.coalesce("text", F.lit(""))
        asked = stored(questions.select("query_id", text.alias("text"), F.sha2(F.concat_ws("\x1f", F.lit(chain), F.lit(corpus), text), 256).alias("digest")), "asked")
        one = asked.groupBy("digest").agg(F.first("text").alias("text"))
        held = stored(one.join(self.table.read(), "digest").where(F.col("version") <= now), "held")
        # words of the documents that differ from the version of each kept result; there are as many versions as were published
        gone = None
        for row in held.where(F.col("version") < now).select("version").distinct().collect():
            changed, _ = versions.difference(self.spark, self.corpora, corpus, row.version, now)
            words = changed.select(F.lit(row.version).alias("version"), F.explode(tokens(F.col("text"))).alias("word")).distinct()
            gone = words if gone is None else gone.unionByName(words)
        good = held
        if gone is not None:
            hit = held.select("digest", "version", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).join(gone, ["version", "word"]).select("digest").distinct()
            good = stored(held.join(hit, "digest", "left_anti"), "good")
        fresh = stored(one.join(good.select("digest"), "digest", "left_anti"), "fresh")
        found = create_chain(chain)(fresh.select(F.col("digest").alias("query_id"), "text"), versions.read(self.spark, self.corpora, corpus, now))
        lists = found.groupBy(F.col("query_id").alias("digest")).agg(F.array_sort(F.collect_list(F.struct(F.col("doc_id").cast("long").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank")))).cast(FOUND).alias("found"))
        new = stored(fresh.select("digest").join(lists, "digest", "left").select("digest", F.coalesce("found", F.array().cast(FOUND)).alias("found")), "new")
        at = F.lit(now).cast("long")
        self.table.upsert(new.select("digest", at.alias("version"), stamped(F.col("found"), at).alias("found")).unionByName(good.select("digest", at.alias("version")), allowMissingColumns=True))
        both = new.select("digest", "found", F.lit(False).alias("cached")).unionByName(good.select("digest", "found", F.lit(True).alias("cached")))
        return asked.join(both, "digest").select("query_id", "cached", F.explode("found").alias("f")).select("query_id", "f.doc_id", "f.score", "f.rank", "cached")

"""Readers and writers: versions of datasets, the vector index, request bodies, feedback facts and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import models, scalars
from tamarisk.functions.text import tokens
from tamarisk.operators import inquiries
from tamarisk.operators.retrieve import vector_top_k
from tamarisk.plans.chains import create_chain, events
from tamarisk.plans.sql import search, top
from tamarisk.sources import files, versions
from tamarisk.sources.tables import load, work_dir


def dataset_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a dataset of two versions, another of one; the latest of each."""
    path, rows = work_dir(spark, "datasets"), load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    for name, part in (("a", "c_nationkey < 10"), ("b", "c_nationkey >= 20"), ("a", "c_nationkey < 5")):
        versions.publish(rows.where(part), path, name)
    return versions.latest(spark, path).select("name", "version", "c_custkey")


def dataset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a dataset; then without some, and with others changed: what changed, from the buckets that differ."""
    path, rows = work_dir(spark, "datasets"), load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    key = F.col("o_orderkey")
    versions.publish(rows, path, "orders")
    versions.publish(rows.where(key % 500 != 3).withColumn("o_orderstatus", F.when(key % 700 == 5, "X").otherwise(F.col("o_orderstatus"))), path, "orders")
    return versions.difference(spark, path, "orders", 1, 2)[0]


def dataset_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two versions, read after the second was published."""
    path, rows = work_dir(spark, "datasets"), load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    versions.publish(rows.where("c_nationkey < 15"), path, "customers")
    versions.publish(rows, path, "customers")
    return versions.read(spark, path, "customers", 1)


def index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is built, built again from fewer rows, and searched."""
    path, rows = work_dir(spark, "index"), load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    files.rebuild_index(rows, path)
    files.rebuild_index(rows.where("vec_id % 2 = 0"), path)
    index = files.open_index(spark, path)
    return vector_top_k(index.where("vec_id % 100 = 0"), index, 3)


def facts_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two facts of each purchase, appended one after the other; then one row a key."""
    path, sent = work_dir(spark, "facts"), load(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").cast("string").alias("call_id"), (F.col("event_id") % 2).cast("double").alias("value"))
    files.append_facts(sent.select("call_id", F.lit("topic_kept").alias("key"), "value"), path)
    files.append_facts(sent.select("call_id", F.lit("edit_similarity").alias("key"), (F.col("value") / 2).alias("value")), path)
    return spark.read.parquet(path).groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def trace_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the naive chain's calls, appended as a trace: how many of each kind a call has."""
    asked, docs = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), load(spark, sf_dir, "documents").select("doc_id", "text")
    path = work_dir(spark, "trace")
    files.append_facts(events(create_chain("naive")(asked, docs), asked, docs).where("kind <> 'token'"), path)
    return spark.read.parquet(path).groupBy("call_id").agg(F.count_if(F.col("kind") == "call").alias("n_calls"), F.count_if(F.col("kind") == "context").alias("n_context"))


def json_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third body is cut off."""
    body = F.when(F.col("event_id") % 3 > 0, scalars.json_record("event_id", "event_type")).otherwise('{"event_id":')
    parsed = files.parse_bodies(load(spark, sf_dir, "events").select("event_id", body.alias("body"), "event_type").drop("event_type"), "event_type string")
    return parsed.select("event_id", F.col("request.event_type").alias("event_type"))


def feedback_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a sent reply: only where call, original topic and topic are all there."""
    key = F.col("c_custkey")
    call, topic, original = F.when(key % 2 == 0, "call").otherwise(""), F.when(key % 3 > 0, "a"), F.when(key % 5 > 0, F.when(key % 7 > 0, "a").otherwise("b"))
    found = inquiries.send_metrics(F.lit("kitten"), F.lit("sitting"), original, topic, call)
    return load(spark, sf_dir, "customer").select("c_custkey", found["operator_edited_topic"].alias("edited"), F.round(found["edit_similarity"], 6).alias("similarity"))


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spam and politeness of turns, by the model functions of the registry."""
    turns = load(spark, sf_dir, "conversations").select("role", models.model("judge_spam")(F.col("text"))["is_spam"].alias("spam"), models.model("politeness_judge")(F.col("text"))["score"].alias("polite"))
    return turns.groupBy("role").agg(F.count_if("spam").alias("n_spam"), F.sum("polite").cast("long").alias("n_polite"), F.count("*").alias("n"))


def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each question over the document of its number, and its words."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("context"))
    asked = load(spark, sf_dir, "benchmark").join(docs, "item_id")
    prompt = models.model("answer")(F.coalesce("context", F.lit("")), F.col("text"))
    return asked.select("item_id", F.md5(prompt).alias("prompt_md5"), F.size(tokens(prompt)).cast("long").alias("n_words"))


QUERIES = {f.__name__: f for f in (dataset_publish, dataset_difference, dataset_as_of, index_rebuild, facts_append, trace_append, json_bodies, feedback_guard, judge_replies, answer_prompts)}
SQL = {
    "dataset_publish": "SELECT 'a' AS name, 2 AS version, c_custkey FROM customer WHERE c_nationkey < 5 UNION ALL SELECT 'b', 1, c_custkey FROM customer WHERE c_nationkey >= 20",
    "dataset_difference": """WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 700 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 500 <> 3),
a AS (SELECT o_orderkey, o_orderstatus FROM orders)
SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""",
    "dataset_as_of": "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey < 15",
    "index_rebuild": """
WITH s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0 AND d.vec_id % 2 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3""",
    "facts_append": """WITH p AS (SELECT CAST(event_id % 2 AS DOUBLE) AS v FROM events WHERE event_type = 'purchase')
SELECT 'topic_kept' AS key, count(*) AS n, sum(v) AS total FROM p UNION ALL SELECT 'edit_similarity', count(*), sum(v / 2) FROM p""",
    "trace_append": f"""WITH {search()}, hit AS ({top('cos', 5)})
SELECT item_id AS call_id, CAST(1 AS BIGINT) AS n_calls, count(hit.doc_id) AS n_context FROM benchmark LEFT JOIN hit ON query_id = item_id GROUP BY 1""",
    "json_bodies": "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type FROM events",
    "feedback_guard": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'a' END AS t, CASE WHEN c_custkey % 5 > 0 THEN CASE WHEN c_custkey % 7 > 0 THEN 'a' ELSE 'b' END END AS o FROM customer)
SELECT c_custkey, t IS DISTINCT FROM o AS edited, CASE WHEN c_custkey % 2 = 0 AND t IS NOT NULL AND o IS NOT NULL THEN 0.571429::DOUBLE END AS similarity FROM c""",
    "judge_replies": r"""SELECT role, count(*) FILTER (regexp_matches(lower(coalesce(text, '')), 'casino|lottery|seo|click here|cheap')) AS n_spam,
  CAST(sum(CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(text, '(?i)\b(idiot|stupid|shut up|moron)\b') THEN 0 ELSE 1 END) AS BIGINT) AS n_polite, count(*) AS n FROM conversations GROUP BY role""",
    "answer_prompts": r"""WITH a AS (SELECT item_id, 'Answer the question from the context.' || chr(10) || 'Context: ' || coalesce(d.text, '') || chr(10) || 'Question: ' || b.text AS prompt FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
SELECT item_id, md5(prompt) AS prompt_md5, CAST(len(list_filter(regexp_split_to_array(prompt, '[ \n\t\r\f\v]+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM a""",
}

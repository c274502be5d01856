"""Writing the inquiry table, jobs with errors, agents and their events, over the tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarisk.functions import models, scalars
from tamarisk.functions.text import tokens
from tamarisk.operators import agents, inquiries
from tamarisk.operators.fuse import reciprocal_rank_fusion
from tamarisk.plans.stream_queries import stream
from tamarisk.sources.tables import load, work_dir
from tamarisk.streaming.attempts import attempt_stream, outcomes
from tamarisk.streaming.threads import job


def bulk_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as inquiries: inserted, all deleted, inserted again; what is missing gets its default."""
    path, now = work_dir(spark, "inquiries"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    key = F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").select(
        F.concat(F.lit("inq_"), key).alias("id"), F.col("c_name").alias("customer_name"), F.concat("c_name", F.lit("@example.com")).alias("customer_email"), F.col("c_mktsegment").alias("content"),
        F.when(key % 3 == 0, "sent").alias("status"), F.when(key % 2 == 0, True).alias("quality_alert"),
    )
    inquiries.insert(rows, path, now)
    inquiries.delete_all(spark, path)
    inquiries.insert(rows, path, now)
    return spark.read.schema(inquiries.SCHEMA).parquet(path).select("id", "status", "quality_alert", "topic", F.col("created_at").cast("timestamp_ntz").alias("created_at"), (F.col("created_at") == F.col("updated_at")).alias("fresh"))


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").withColumn("topic", F.lit(None).cast("string")).select("o_orderkey", scalars.json_record("o_orderkey", "o_orderstatus", "topic").alias("body"))


def confidence_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.when(F.col("event_id") % 7 > 0, F.col("value") / 100.0)
    return load(spark, sf_dir, "events").groupBy("event_type", inquiries.is_confidence(confidence).alias("is_valid")).agg(F.count("*").alias("n"))


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as inquiries; every fifth has no content, and its job fails."""
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("A").alias("customer_name"), F.lit("").alias("company_name"), F.when(F.col("p_partkey") % 5 > 0, F.concat_ws(" ", "p_name", "p_type")).alias("content"))
    return job(rows).select("id", "status", "topic", "error")


def tool_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each thread counts down from its number modulo 4, a tool call a step."""
    start = load(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("thread_id"), F.lit(0).cast("long").alias("seq"), F.lit("user").alias("role"), (F.col("conv_id") % 4).cast("string").alias("content"), F.lit(None).cast(agents.CALLS).alias("calls"))
    call = F.array(F.struct(F.lit("1").alias("id"), F.lit("decrease").alias("name"), F.lit("x").alias("args")))

    def model(content, n):
        own = F.transform(call, lambda c: F.struct(n.cast("string").alias("id"), c["name"].alias("name"), content.alias("args")))
        more = content.cast("int") > 0
        return F.struct(F.when(more, "").otherwise("done").alias("content"), F.when(more, own).alias("calls"))

    done = agents.tool_loop(start, model, {"decrease": lambda args: args.cast("int") - 1})
    counts = done.groupBy("thread_id").agg(F.count("*").alias("n_messages"), F.count_if(F.col("role") == "tool").alias("n_tool"))
    return counts.join(agents.final_content(done), "thread_id")


def tool_calls_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.array(F.struct(F.lit("1").alias("id"), F.lit("turn_light").alias("name"), F.lit("{}").alias("args")))
    calls = F.when(F.col("turn") % 3 == 0, some).when(F.col("turn") % 3 == 1, F.slice(some, 1, 0))
    return load(spark, sf_dir, "conversations").groupBy("role", agents.has_calls(calls).alias("calls")).agg(F.count("*").alias("n"))


def sub_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a nested agent: what it gives back."""
    messages = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("thread_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return agents.final_content(messages).select("thread_id", F.md5(F.coalesce("content", F.lit(""))).alias("content_md5"))


def nested_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn asks an agent that asks an agent of its own for the words of a text, which asks a tool."""
    start = load(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("thread_id"), F.lit(0).cast("long").alias("seq"), F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content"), F.lit(None).cast(agents.CALLS).alias("calls"))

    def asks(name: str, said: str):
        def model(content, n):
            call = F.array(F.struct(F.lit("1").alias("id"), F.lit(name).alias("name"), content.alias("args")))
            return F.struct(F.when(n == 0, "").otherwise(F.concat(F.lit(said), content)).alias("content"), F.when(n == 0, call).alias("calls"))

        return model

    counter = agents.Agent(asks("length", "words: "), {"length": lambda args: F.size(tokens(args)).cast("string")})
    clerk = agents.Agent(asks("counter", "it has "), agents={"counter": counter})
    done = agents.tool_loop(start, asks("clerk", "answer: "), {}, agents={"clerk": clerk})
    return agents.thread_status(done)


def job_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts through a model that is out of order for some, and answers others at the second try."""
    folder = work_dir(spark, "attempts")
    rows = stream(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("content"))

    def call(row: dict, number: int) -> dict:
        if row["id"] % 7 == 0 or row["id"] % 5 == 0 and number == 1:
            raise TimeoutError(f"no answer to {row['id']}")
        return {"n_chars": len(row["content"])}

    attempt_stream(rows, f"{folder}/out", f"{folder}/checkpoint", call, "n_chars long").awaitTermination()
    return outcomes(spark, f"{folder}/out").select("id", "outcome", "attempts", "error", F.col("result.n_chars").alias("n_chars"))


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of two stages, and an event of the first where it is sure."""
    content = F.concat_ws(" ", "p_name", "p_type")
    classified = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), models.model("classify_topic")(content).alias("t"), content.alias("content")).select("id", "t.topic", "t.confidence", "content")
    drafted = classified.where("topic <> 'spam'").select("id", models.model("generate_response")(F.col("topic"), F.lit("A"), F.lit(""), F.col("content")).alias("draft"))
    stages = {"classify": classified.select("id", "topic", "confidence"), "generate": drafted}
    found = agents.staged(stages, "id", {"classify": F.when(F.col("confidence") > 0.6, F.col("topic"))})
    return agents.of_kinds(found, "update", "custom").groupBy("stage", "kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


def changed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of which every second was answered, and of these every third with another text."""
    questions = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    answered = questions.where("query_id % 2 = 0").withColumn("text", F.when(F.col("query_id") % 3 == 0, "other").otherwise(F.col("text")))
    return agents.changed(questions, answered).select("query_id")


def fusion_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: the longest documents and the first ones, fused by a key of id and source."""
    docs = load(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), "doc_id", "source", "n_chars")
    lists = [docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("rank <= 20").withColumn("list_no", F.lit(i)) for i, order in enumerate(((F.desc("n_chars"), "doc_id"), ("doc_id",)))]
    ranked = lists[0].unionByName(lists[1]).withColumn("doc_key", scalars.document_key("doc_id", "source"))
    return reciprocal_rank_fusion(ranked, doc="doc_key")


def unescaped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", scalars.unescaped(F.concat(F.lit("caf\\u00e9 "), "p_name")).alias("shown"))


QUERIES = {f.__name__: f for f in (bulk_insert, json_records, confidence_range, job_status, tool_loop, tool_calls_present, sub_agent, nested_agent, job_attempts, stage_events, changed_questions, fusion_by_key, unescaped_text)}
_TOPIC = """CASE WHEN regexp_matches(low, 'casino|lottery|seo|click here|cheap') THEN 'spam' WHEN regexp_matches(low, 'develop|build|system|project') THEN 'development'
  WHEN regexp_matches(low, 'product|price|license|plan') THEN 'product' ELSE 'other' END"""
_PARTS = f"p AS (SELECT p_partkey, {_TOPIC} AS topic FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS low FROM part))"
SQL = {
    "bulk_insert": """SELECT 'inq_' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'sent' ELSE 'processing' END AS status, c_custkey % 2 = 0 AS quality_alert,
  CAST(NULL AS VARCHAR) AS topic, TIMESTAMP '2024-01-01 00:00:00' AS created_at, true AS fresh FROM customer""",
    "json_records": """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","topic":null}' AS body FROM orders""",
    "confidence_range": "SELECT event_type, coalesce(CASE WHEN event_id % 7 > 0 THEN value / 100.0::DOUBLE END BETWEEN 0 AND 1, false) AS is_valid, count(*) AS n FROM events GROUP BY ALL",
    "job_status": f"""WITH {_PARTS} SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 5 > 0 THEN 'draft' ELSE 'error' END AS status,
  CASE WHEN p_partkey % 5 > 0 THEN topic END AS topic, CASE WHEN p_partkey % 5 = 0 THEN 'no content' END AS error FROM p""",
    "tool_loop": "SELECT CAST(conv_id AS VARCHAR) AS thread_id, 2 + 2 * (conv_id % 4) AS n_messages, conv_id % 4 AS n_tool, 'done' AS content FROM (SELECT DISTINCT conv_id FROM conversations)",
    "tool_calls_present": "SELECT role, turn % 3 = 0 AS calls, count(*) AS n FROM conversations GROUP BY ALL",
    "sub_agent": "SELECT CAST(conv_id AS VARCHAR) AS thread_id, md5(coalesce(arg_max(text, turn), '')) AS content_md5 FROM conversations GROUP BY conv_id",
    "nested_agent": r"""SELECT conv_id || '-' || turn AS thread_id, 'done' AS status,
  'answer: it has words: ' || len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n\t\r\f\v]+'), lambda x: x <> '')) AS content FROM conversations""",
    "job_attempts": """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'dead' ELSE 'done' END AS outcome, CAST(CASE WHEN p_partkey % 7 = 0 THEN 3 WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS INT) AS attempts,
  CASE WHEN p_partkey % 7 = 0 THEN 'TimeoutError: no answer to ' || p_partkey END AS error, CASE WHEN p_partkey % 7 <> 0 THEN length(p_name || ' ' || p_type) END AS n_chars FROM part""",
    "stage_events": f"""WITH {_PARTS} SELECT 'classify' AS stage, 'update' AS kind, count(*) AS n, count(DISTINCT p_partkey) AS n_ids FROM p
UNION ALL SELECT 'classify', 'custom', count(*), count(DISTINCT p_partkey) FROM p WHERE topic <> 'other' HAVING count(*) > 0
UNION ALL SELECT 'generate', 'update', count(*), count(DISTINCT p_partkey) FROM p WHERE topic <> 'spam' HAVING count(*) > 0""",
    "changed_questions": "SELECT item_id AS query_id FROM benchmark WHERE item_id % 2 <> 0 OR item_id % 3 = 0",
    "fusion_by_key": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, 0 AS list_no FROM documents QUALIFY rank <= 20),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, 1 AS list_no FROM documents QUALIFY rank <= 20),
u AS (SELECT lang AS query_id, sha256('{"doc_id":' || doc_id || ',"source":"' || source || '"}') AS doc_key, rank, list_no FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
f AS (SELECT query_id, doc_key, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS score, min(list_no * 1000 + rank) AS f FROM u GROUP BY 1, 2)
SELECT query_id, doc_key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, doc_key) AS rank FROM f QUALIFY rank <= 5""",
    "unescaped_text": "SELECT p_partkey, 'café ' || p_name AS shown FROM part",
}

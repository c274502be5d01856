"""Chunks, citations, conversations, tools and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import scalars, text
from tamarisk.functions.models import model
from tamarisk.operators import conversations
from tamarisk.operators.fuse import first_seen
from tamarisk.sources.tables import load
from tamarisk.streaming.threads import batch_states

#: Tools by name, for calls that stand in as events.
TOOLS = {"click": "turn_light", "purchase": "generate_random_number", "view": "get_current_weather"}


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = text.fixed_chunks(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunks.select("doc_id", "chunk_no", F.char_length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.recursive_chunk_rows(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "chunk_no", F.char_length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def citation_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 40)
    return load(spark, sf_dir, "documents").select("doc_id", scalars.citation_label(scalars.prefixed("../", F.col("source")), page).alias("label"))


def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.token_stream(load(spark, sf_dir, "conversations"), "conv_id", "turn")
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n_tokens"), F.countDistinct("token").alias("n_distinct"))


def token_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.accumulated(conversations.token_stream(load(spark, sf_dir, "conversations"), "conv_id", "turn"), "conv_id", "turn")
    return rows.select("conv_id", "turn", F.md5("text").alias("text_md5"))


def last_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.last_message(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def new_messages_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.messages_since(load(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role")


def distinct_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_seen(load(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "turn", "role")


def last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "click", scalars.light_state(F.col("value") > 50))
    return conversations.last_state(load(spark, sf_dir, "events"), "user_id", "event_id", state)


def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's name and its segment: how alike they are."""
    return load(spark, sf_dir, "customer").select("c_custkey", F.round(scalars.edit_similarity(F.col("c_name"), F.col("c_mktsegment")), 6).alias("edit_similarity"))


def edit_similarity_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each turn's whole text and that of the next: how alike they are, by characters. No SQL: DuckDB's levenshtein counts bytes."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return turns.join(following, ["conv_id", "turn"]).select("conv_id", "turn", F.round(scalars.edit_similarity(F.col("text"), F.col("next_text")), 6).alias("edit_similarity"))


def tool_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame(list(TOOLS.items()), "event_type string, tool string")
    return conversations.dispatched(load(spark, sf_dir, "events"), tools, "event_type").groupBy("event_type", "tool").agg(F.count("*").alias("n"))


def weather_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as calls of the weather tool, for the nation of their user's customer."""
    calls = load(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", F.col("user_id").alias("c_custkey"))
    places = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select("c_custkey", "n_name")
    return calls.join(places, "c_custkey").select("event_id", F.to_json(scalars.current_weather(F.col("n_name"))).alias("result"))


def tool_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as calls and purchases of the same user and second number as results."""
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 50).alias("call"))
    calls, results = events.where("event_type = 'click'"), events.where("event_type = 'purchase'").select("user_id", "call")
    return conversations.unanswered(calls, results, ["user_id", "call"]).select("event_id", "user_id", "call")


def rejected_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = load(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("thread_id"), F.col("event_id").cast("string").alias("tool_call_id"))
    return conversations.rejections(calls, "try another way").groupBy("role", "status").agg(F.count("*").alias("n"))


def forbidden_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = load(spark, sf_dir, "documents").select(model("forbidden_content_judge")(F.col("text")).alias("j"))
    return judged.groupBy("j.score", "j.comment").agg(F.count("*").alias("n"))


def hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an assistant's words all come from the turn before."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.tokens(F.col("text")).alias("words"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("words").alias("context"))
    return turns.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", model("answer_hallucination")(F.col("context"), F.col("words")).alias("score"))


def thread_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_states(load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("thread_id"), F.col("event_id").alias("seq"), "event_type"))


def split_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat_ws(">=", "p_name", F.lit("1.0"))
    listed = F.concat_ws(", ,", "p_brand", "p_type")
    return load(spark, sf_dir, "part").select("p_partkey", scalars.first_name_of_requirement(spec).alias("name"), F.concat_ws("|", scalars.split_list(listed)).alias("listed"), scalars.integer_or(F.substring("p_brand", -2, 2), 20).alias("number"))


QUERIES = {f.__name__: f for f in (
    chunk_fixed, chunk_recursive, citation_label, token_stream, token_accumulate, last_message, new_messages_since, distinct_first_seen, last_state, edit_similarity, edit_similarity_turns, tool_dispatch, weather_tool, tool_orphans, rejected_calls,
    forbidden_content, hallucination, thread_states, split_functions,
)}
_TOKENS = "SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), '')) AS token FROM conversations"
_WORD = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \n\t\r\f\v]+'), lambda x: x <> '')"
SQL = {
    "chunk_fixed": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((n - 100) / 900) AS BIGINT), 1))) AS chunk_no FROM d)
SELECT doc_id, chunk_no, length(substring(text, chunk_no * 900 + 1, 1000)) AS n_chars, md5(substring(text, chunk_no * 900 + 1, 1000)) AS chunk_md5 FROM c""",
    "citation_label": "SELECT doc_id, '../' || source || CASE WHEN doc_id % 3 > 0 THEN ' (p.' || (doc_id % 40 + 1) || ')' ELSE '' END AS label FROM documents",
    "token_stream": f"SELECT conv_id, turn, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM ({_TOKENS}) WHERE token <> '' GROUP BY 1, 2",
    "token_accumulate": "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations WHERE coalesce(text, '') <> ''",
    "last_message": "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY 1",
    "new_messages_since": "SELECT conv_id, turn, role FROM conversations WHERE turn >= 2",
    "distinct_first_seen": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1",
    "last_state": "SELECT user_id, arg_max(CASE WHEN value > 50 THEN 'on' ELSE 'off' END, event_id) FILTER (event_type = 'click') AS state FROM events GROUP BY 1",
    "edit_similarity": "SELECT c_custkey, round(1.0::DOUBLE - levenshtein(c_name, c_mktsegment)::DOUBLE / greatest(length(c_name), length(c_mktsegment)), 6) AS edit_similarity FROM customer",
    "weather_tool": """SELECT event_id, '{"location":"' || n_name || '","temperature":"25","unit":"celsius"}' AS result
FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey WHERE event_type = 'view'""",
    "tool_dispatch": "SELECT event_type, CASE event_type WHEN 'click' THEN 'turn_light' WHEN 'purchase' THEN 'generate_random_number' WHEN 'view' THEN 'get_current_weather' END AS tool, count(*) AS n FROM events GROUP BY 1, 2",
    "tool_orphans": """SELECT event_id, user_id, event_id % 50 AS call FROM events e WHERE event_type = 'click'
  AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'purchase' AND r.user_id = e.user_id AND r.event_id % 50 = e.event_id % 50)""",
    "rejected_calls": """SELECT 'tool' AS role, 'error' AS status, count(*) AS n FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'user', NULL, count(DISTINCT user_id) FROM events WHERE event_type = 'purchase'""",
    "forbidden_content": r"""WITH j AS (SELECT text, CASE WHEN regexp_matches(text, '(?i)([$€¥£]\s?\d|\d[\d,.]*\s?(yen|usd|dollars|eur|euros))') THEN 'money figure'
  WHEN regexp_matches(text, '(?i)\b(guarantee|definitely|absolutely|100%)') THEN 'unverified assertion' WHEN text IS NOT NULL THEN 'clean' END AS comment FROM documents)
SELECT CASE WHEN comment IS NOT NULL THEN CAST(comment = 'clean' AS INT) END AS score, comment, count(*) AS n FROM j GROUP BY ALL""",
    "hallucination": f"""WITH t AS (SELECT conv_id, turn, role, {_WORD.format('text')} AS ws FROM conversations)
SELECT a.conv_id, a.turn, CAST(list_has_all(b.ws, a.ws) AS INT) AS score FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn WHERE a.role = 'assistant'""",
    "thread_states": """SELECT CAST(user_id AS VARCHAR) AS thread_id, count(*) AS n_events, CASE arg_max(event_type, event_id) FILTER (event_type IN ('click', 'purchase', 'view')) WHEN 'click' THEN 'waiting' WHEN 'purchase' THEN 'approved' WHEN 'view' THEN 'rejected' END AS state
FROM events GROUP BY 1""",
    "split_functions": r"""SELECT p_partkey, regexp_split_to_array(p_name || '>=1.0', '[\s<>=!~]+')[1] AS name, p_brand || '|' || p_type AS listed,
  coalesce(try_cast(right(p_brand, 2) AS INT), 20) AS number FROM part""",
}

"""Stored indexes, the keyed table and streams of calls, over the tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions.text import tokens
from tamarisk.operators import embedding, inquiries, postings, vector_index
from tamarisk.operators.keyed_table import KeyedTable
from tamarisk.operators.sorted_table import SortedTable
from tamarisk.operators.spans import subtree_totals
from tamarisk.plans.answer_cache import AnswerCache
from tamarisk.plans.inquiry_queries import SQL as INQUIRIES
from tamarisk.plans.inquiry_queries import inquiry_events
from tamarisk.plans.retrieval_queries import SQL as RETRIEVAL
from tamarisk.plans.stream_queries import kept, rocksdb, stream
from tamarisk.plans.sql import DOCS, ITEMS, search, top
from tamarisk.sources import versions
from tamarisk.sources.files import latest_row
from tamarisk.sources.tables import load, work_dir
from tamarisk.streaming.calls import feedback_joined, reviews, token_pieces

WAIT_MS, DELAY = 6 * 3_600_000, "1 hour"


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is built, then searched for every hundredth vector."""
    rows, path = load(spark, sf_dir, "embeddings"), work_dir(spark, "vector-index")
    vector_index.build(rows, path)
    return vector_index.VectorIndex(spark, path).search(rows.where("vec_id % 100 = 0"))


def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items embedded by a decomposition of the documents; the nearest documents of each item. No SQL: it has
    no decomposition."""
    docs, path = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), work_dir(spark, "embedding-index")
    model = embedding.fit(docs)
    vector_index.build(embedding.embedded(docs, model), path)
    asked = embedding.embedded(load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"), "text"), model)
    return vector_index.VectorIndex(spark, path).search(asked)


def postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is built of two thirds of the documents, the others are appended; then all benchmark items are asked."""
    docs, path = load(spark, sf_dir, "documents").select("doc_id", "text"), work_dir(spark, "postings-index")
    postings.append(docs.where("doc_id % 3 > 0"), path)
    postings.append(docs.where("doc_id % 3 = 0"), path)
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("words"))
    return postings.Postings(spark, path).bm25(asked, 20)


def status_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four batches, late ones first, merged into a keyed table that is compacted on the way; what is read is the fold."""
    events, state = inquiry_events(spark, sf_dir), KeyedTable(spark, work_dir(spark, "states"), "id", inquiries.STATE, inquiries.STATE_MERGES)
    for part in (3, 1, 0, 2):
        state.upsert(inquiries.state_changes(events.where(F.pmod(F.floor(F.col("seq") / 7), F.lit(4)) == part)))
        if part == 1:
            state.compact()
    return state.read()


def inquiry_seek_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of finished orders, behind the last row of the first."""
    table = SortedTable(spark, f"{work_dir(spark, 'pages')}/orders", "o_orderstatus", "o_orderdate", "o_orderkey")
    table.build(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"), 16)
    last = table.page("F", 20).collect()[-1:]
    return table.page("F", 20, (last[0].o_orderdate, last[0].o_orderkey)) if last else table.page("F", 0)


def inquiry_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order, from the files whose Bloom filter may hold it."""
    table = SortedTable(spark, f"{work_dir(spark, 'keys')}/orders", "o_orderstatus", "o_orderdate", "o_orderkey")
    table.build(load(spark, sf_dir, "orders"), 16)
    return table.lookup(7)


def call_tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans: those of a block of 64 hang below its first, a third of them directly, the others one below the other."""
    n = F.col("event_id")
    parent = F.when(n % 64 == 0, None).when(n % 3 == 0, n - n % 64).otherwise(n - 1)
    spans = load(spark, sf_dir, "events").select(n.alias("span_id"), parent.alias("parent_id"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return subtree_totals(spans, ["cents"])


def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions, and the last word of each, of a corpus; then again after documents were added: what stays good is not asked again."""
    path, docs = work_dir(spark, "cache"), load(spark, sf_dir, "documents").select("doc_id", "text")
    questions = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    words = questions.select((-F.col("query_id") - 1).alias("query_id"), F.element_at(tokens(F.col("text")), -1).alias("text")).where("text IS NOT NULL")
    versions.publish(docs.where("doc_id % 50 <> 3"), f"{path}/corpora", "documents")
    cache = AnswerCache(spark, f"{path}/answers", f"{path}/corpora")
    asked = questions.unionByName(words)
    cache.ask(asked, "naive", "documents")
    versions.publish(docs, f"{path}/corpora", "documents")
    return cache.ask(asked, "naive", "documents")


def _reviewed(events: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for p in {"click": "ask", "purchase": "approve", "view": "reject"}.items() for x in p])
    return events.select(F.col("user_id").cast("string").alias("thread_id"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("kind"), "ts")


def call_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as calls that wait for a purchase (approved) or a view (rejected) of their user, six hours at most."""
    folder = work_dir(spark, "reviews")
    with rocksdb(spark):
        kept(reviews(_reviewed(stream(spark, sf_dir, "events")), WAIT_MS, DELAY), "update", folder)
    return latest_row(spark.read.parquet(f"{folder}/out"), ["thread_id", "call_id"], "batch", []).select("thread_id", "call_id", "state", "decided_by")


def ordered_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every turn as tokens that come out of order over several batches, a fifth of them twice; put together again."""
    folder = work_dir(spark, "tokens")
    # dealt before the texts become tokens, which are many more bytes
    rows = load(spark, sf_dir, "conversations").where("text IS NOT NULL").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")
    turns = rows.select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.posexplode(F.split("text", "(?<= )")).alias("i", "token"))
    shuffled = turns.select("key", F.col("i").cast("long").alias("i"), "token", F.explode(F.when(F.col("i") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    parts = 4
    # every task writes a file of each part, and a batch takes a share of all files
    shuffled.withColumn("part", F.pmod(F.xxhash64("key", "i", "again"), F.lit(parts))).drop("again").write.partitionBy("part").parquet(f"{folder}/tokens")
    n_files = len(spark.read.parquet(f"{folder}/tokens").inputFiles())
    with rocksdb(spark):
        kept(token_pieces(spark.readStream.schema("key string, i long, token string, part int").option("maxFilesPerTrigger", max(1, -(-n_files // parts))).parquet(f"{folder}/tokens"), max(1, rows.count() // 256)), "append", folder)
    whole = spark.read.parquet(f"{folder}/out").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), "").alias("text"), F.sum("n").alias("n_tokens"))
    return whole.select("key", F.md5("text").alias("text_md5"), "n_tokens")


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and feedback as two streams, joined until both have ended."""
    folder = work_dir(spark, "feedback")
    events = inquiry_events(spark, sf_dir, stream(spark, sf_dir, "events"))
    again = inquiry_events(spark, sf_dir, stream(spark, sf_dir, "events"))
    calls = events.where("kind = 'generated'").select(F.col("seq").alias("call"), "topic", "at")
    sent = again.where("kind = 'sent'").select((F.col("seq") - 1).alias("call"), (F.col("seq") % 3 > 0).cast("int").alias("kept"), "edit_similarity", "at")
    kept(feedback_joined(calls, sent, "48 HOURS", "10 minutes"), "append", folder)
    return spark.read.parquet(f"{folder}/out")


def feedback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _feedback(spark, sf_dir).where("fed_call IS NOT NULL")
    return found.groupBy("topic").agg(F.count("*").alias("n"), F.round(F.avg("kept"), 6).alias("kept_rate"), F.round(F.avg("edit_similarity"), 6).alias("mean_similarity"))


def calls_without_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that no feedback came for until two days after them."""
    return _feedback(spark, sf_dir).where("fed_call IS NULL").select("call", "topic")


QUERIES = {f.__name__: f for f in (vector_index_topk, embedding_topk, postings_topk, status_merge, inquiry_seek_page, inquiry_key_lookup, call_tree_totals, cached_answers, call_reviews, ordered_tokens, feedback_stream, calls_without_feedback)}
SQL = {
    "vector_index_topk": RETRIEVAL["vector_topk"],
    "postings_topk": RETRIEVAL["bm25_topk"],
    "status_merge": INQUIRIES["status_fold"],
    "inquiry_seek_page": INQUIRIES["inquiry_page"],
    "inquiry_key_lookup": INQUIRIES["inquiry_point_lookup"],
    "call_tree_totals": """
WITH RECURSIVE s AS (
  SELECT event_id AS span_id, CASE WHEN event_id % 64 = 0 THEN NULL WHEN event_id % 3 = 0 THEN event_id - event_id % 64 ELSE event_id - 1 END AS parent_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
a AS (SELECT span_id, span_id AS above, parent_id AS next, cents FROM s UNION ALL SELECT a.span_id, s.span_id, s.parent_id, a.cents FROM a JOIN s ON s.span_id = a.next),
d AS (SELECT span_id, count(*) - 1 AS depth FROM a GROUP BY 1), t AS (SELECT above AS span_id, count(*) AS n_spans, CAST(sum(cents) AS BIGINT) AS cents FROM a GROUP BY 1)
SELECT span_id, parent_id, depth, n_spans, t.cents FROM s JOIN d USING (span_id) JOIN t USING (span_id)""",
    "cached_answers": f"""
WITH {search(DOCS, f"SELECT * FROM ({ITEMS}) UNION ALL SELECT -query_id - 1, ws[-1:] FROM ({ITEMS}) WHERE len(ws) > 0")},
gone AS (SELECT DISTINCT term FROM t WHERE doc_id % 50 = 3), hit AS (SELECT DISTINCT query_id FROM q JOIN gone USING (term))
SELECT c.*, query_id NOT IN (SELECT query_id FROM hit) AS cached FROM ({top('cos', 5)}) c""",
    "call_reviews": """
WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'),
d AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'approved' ELSE 'rejected' END AS state FROM events WHERE event_type IN ('purchase', 'view')),
w AS (SELECT max(ts) - INTERVAL 1 HOUR AS reached FROM events WHERE event_type IN ('click', 'purchase', 'view')),
f AS (
  SELECT c.user_id, c.event_id, c.ts, arg_min(d.event_id, (d.ts, d.event_id)) AS decided_by, arg_min(d.state, (d.ts, d.event_id)) AS state
  FROM c LEFT JOIN d ON d.user_id = c.user_id AND (d.ts > c.ts OR d.ts = c.ts AND d.event_id > c.event_id) AND d.ts <= c.ts + INTERVAL 6 HOUR GROUP BY 1, 2, 3)
SELECT CAST(user_id AS VARCHAR) AS thread_id, event_id AS call_id, coalesce(state, CASE WHEN ts + INTERVAL 6 HOUR <= reached THEN 'expired' ELSE 'waiting' END) AS state, decided_by FROM f, w""",
    "ordered_tokens": "SELECT conv_id || '-' || turn AS key, md5(text) AS text_md5, len(string_split(text, ' ')) AS n_tokens FROM conversations WHERE text IS NOT NULL",
    "feedback_stream": INQUIRIES["feedback_kpi"],
    "calls_without_feedback": """
WITH e AS (SELECT event_id AS seq, event_id % 8 AS k, (['product','development','other','spam'])[user_id % 4 + 1] AS topic, ts FROM events),
c AS (SELECT * FROM e WHERE k IN (1, 6)), f AS (SELECT seq - 1 AS call, ts FROM e WHERE k = 7),
w AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM f)) - INTERVAL 10 MINUTE AS reached)
SELECT seq AS call, topic FROM c, w WHERE c.ts + INTERVAL 48 HOUR < reached AND NOT EXISTS (SELECT 1 FROM f WHERE f.call = c.seq AND f.ts >= c.ts AND f.ts <= c.ts + INTERVAL 48 HOUR)""",
}

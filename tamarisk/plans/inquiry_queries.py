"""The inquiry table, its events and its metrics, over the tables that stand in for them.

Orders stand in for inquiries (status, creation time), events for status events, calls and feedback, labels for expected
labels and judgements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarisk.functions import models, scalars
from tamarisk.operators import evals, inquiries
from tamarisk.sources.files import flatten_examples, latest_row
from tamarisk.sources.tables import load

_PAGE = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]
#: Event types as kinds of status events, and as tools.
KINDS = {"signup": "created", "view": "generated", "click": "saved", "purchase": "sent", "refund": "failed", "login": "created", "logout": "retopic"}


def inquiry_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inquiries.page(load(spark, sf_dir, "orders"), _PAGE, {"o_orderstatus": "F", "o_orderpriority": None}, "o_orderdate", "o_orderkey", 20, 20)


def inquiry_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inquiries.count(load(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "all"})


def inquiry_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inquiries.lookup(load(spark, sf_dir, "orders"), "o_orderkey", 7)


def inquiry_events(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """One inquiry for each user; the kind of an event follows from its number, so that all kinds occur. rows may be a stream."""
    kinds = F.array(*[F.lit(k) for k in ("created", "generated", "saved", "retopic", "failed", "retried", "generated", "sent")])
    topics = F.array(*[F.lit(t) for t in inquiries.TOPICS])
    return (load(spark, sf_dir, "events") if rows is None else rows).select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), kinds[(F.col("event_id") % 8).cast("int")].alias("kind"), topics[(F.col("user_id") % 4).cast("int")].alias("topic"),
        F.round("value", 4).alias("confidence"), F.col("event_type").alias("draft"), F.col("event_type").alias("final"), (F.col("event_id") % 100 / 100.0).alias("edit_similarity"), F.col("ts").alias("at"),
        (F.col("event_id") % 3 == 0).alias("quality_alert"), F.col("event_id").cast("string").alias("call_id"), (F.col("event_id") % 5 == 0).alias("operator_edited_topic"),
    )


def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inquiries.fold(inquiry_events(spark, sf_dir)).select("id", "status", "topic", "original_topic", "classification_confidence", "draft", "final", "edit_similarity", "created_at", "updated_at", "sent_at", "quality_alert", "call_id", "operator_edited_topic")


def quality_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "OK").when(F.col("toxic") == 1, "NG").alias("politeness"))
    return rows.select("doc_id", inquiries.quality_alert(F.col("politeness")).alias("quality_alert"))


def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").withColumn("topic", F.element_at(F.split("role", "s"), 1))
    checked = inquiries.validate(rows, ["role", "topic"])
    return checked.groupBy("is_valid", F.col("role").isin("user", "assistant").alias("known_role")).agg(F.count("*").alias("n"))


def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored inquiries: JSON text, empty or missing, and flags as integers."""
    n = F.col("event_id")
    raw = load(spark, sf_dir, "events").select(
        "event_id", F.when(n % 3 > 0, scalars.json_record("event_type", "props")).otherwise("").alias("ai_response"), F.when(n % 4 > 0, F.concat(F.lit('{"subject":"s","body":"'), "event_type", F.lit('"}'))).alias("final_response"),
        F.when(n % 5 > 0, (n % 2).cast("int")).alias("operator_edited_topic"), F.when(n % 7 > 0, (n % 2).cast("int")).alias("quality_alert"),
    )
    read = inquiries.decode(raw)
    return read.select("event_id", F.col("ai_response").isNotNull().alias("has_draft"), F.col("final_response.body").alias("body"), "operator_edited_topic", "quality_alert")


def feedback_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of kept topics and mean similarity of sent texts, by topic of the call that they are feedback on."""
    events = inquiry_events(spark, sf_dir)
    calls = events.where("kind = 'generated'").select(F.col("seq").alias("call"), "topic")
    feedback = events.where("kind = 'sent'").select((F.col("seq") - 1).alias("call"), (F.col("seq") % 3 > 0).cast("int").alias("kept"), "edit_similarity")
    return feedback.join(calls, "call").groupBy("topic").agg(F.count("*").alias("n"), F.round(F.avg("kept"), 6).alias("kept_rate"), F.round(F.avg("edit_similarity"), 6).alias("mean_similarity"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a rule's prediction: a document of at least 300 characters is of quality."""
    return load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id").withColumn("predicted", (F.col("n_chars") >= 300).cast("int"))


def classification_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _predictions(spark, sf_dir).withColumn("score", evals.accuracy(F.col("predicted"), F.col("quality")))
    return scored.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("accuracy"))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir)
    scored = rows.withColumns({"classification_accuracy": evals.accuracy(F.col("predicted"), F.col("quality")), "politeness": evals.judgement_score(F.when(F.col("predicted") == 1, F.when(F.col("toxic") == 1, "NG").otherwise("OK")), "OK", "NG")})
    return evals.summary(evals.unpivoted(scored, "doc_id", ["classification_accuracy", "politeness"]))


def dataset_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nested examples; what is missing is null."""
    inputs = F.struct(F.col("c_name").alias("customer_name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("company_name"), F.col("c_custkey").cast("string").alias("content"))
    outputs = F.when(F.col("c_custkey") % 3 > 0, F.struct(F.lit("other").alias("topic"), F.lit("").alias("response_body")))
    return flatten_examples(load(spark, sf_dir, "customer").select(inputs.alias("inputs"), outputs.alias("expected_outputs")))


def dataset_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_row(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", ["o_orderkey"])


def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = {"F": "Finished", "O": "Open", "P": "Pending"}
    return load(spark, sf_dir, "orders").groupBy(F.coalesce(scalars.label_lookup(F.col("o_orderstatus"), labels), F.lit("Other")).alias("label")).agg(F.count("*").alias("n"))


def format_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.display_time(when).alias("shown"), scalars.percent((F.col("o_orderkey") % 100) / 100.0).alias("share"), scalars.minutes_before(when, F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 500).cast("int"))).alias("earlier"))


def coalesce_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty counts as missing for the one, not for the other."""
    empty = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.col("c_name"))
    return load(spark, sf_dir, "customer").select("c_custkey", scalars.falsy_or(empty, F.lit("none")).alias("falsy"), F.coalesce(empty, F.lit("none")).alias("nullish"), inquiries.shown_text(empty, F.col("c_mktsegment")).alias("shown"))


def topic_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic, original = F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment"))
    return load(spark, sf_dir, "customer").select("c_custkey", inquiries.topic_edited(topic, original).alias("edited"), (scalars.is_filled(topic) & scalars.is_filled(original)).alias("known"))


def classify_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by words: part names as inquiries; spam gets no draft."""
    judged = load(spark, sf_dir, "part").select("p_partkey", models.model("classify_topic")(F.concat_ws(" ", "p_name", "p_type")).alias("t"), F.concat_ws(" ", "p_name", "p_type").alias("content"))
    reply = models.model("generate_response")(F.col("t.topic"), F.lit("A"), F.lit(""), F.col("content"))
    drafted = judged.select("p_partkey", "t.topic", F.round("t.confidence", 6).alias("confidence"), F.when(F.col("t.topic") != "spam", reply).alias("draft"))
    return drafted.select("p_partkey", "topic", "confidence", F.col("draft.body").alias("body"), inquiries.quality_alert(models.model("check_quality")(F.col("draft.body"))["politeness"]).alias("quality_alert"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the status of their latest order."""
    last = latest_row(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"]).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("c_mktsegment"))
    return inquiries.apply_updates(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), last, "c_custkey")


def display_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey")
    rows = load(spark, sf_dir, "customer").withColumns({"i": F.row_number().over(w.orderBy("c_custkey")), "n": F.count("*").over(w)})
    return rows.select("c_custkey", F.concat_ws("/", "i", "n").alias("position"))


_EVENTS = """
ev AS (
  SELECT user_id AS id, event_id AS seq, (['created','generated','saved','retopic','failed','retried','generated','sent'])[event_id % 8 + 1] AS kind,
         (['product','development','other','spam'])[user_id % 4 + 1] AS topic, round(value, 4) AS confidence, event_type, (event_id % 100) / 100.0::DOUBLE AS es, ts FROM events)"""
_PRED = "p AS (SELECT l.*, n_chars, lang, source, CAST(n_chars >= 300 AS INT) AS predicted FROM labels l JOIN documents d USING (doc_id))"

QUERIES = {f.__name__: f for f in (
    inquiry_page, inquiry_count, inquiry_point_lookup, status_fold, quality_alert, validation_split, json_decode, feedback_kpi, classification_accuracy, eval_summary, dataset_flatten,
    dataset_latest_version, label_lookup, format_display, coalesce_fallback, topic_edited, classify_topics, upsert_latest, display_index,
)}
SQL = {
    "inquiry_page": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20",
    "inquiry_count": "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'",
    "inquiry_point_lookup": "SELECT * FROM orders WHERE o_orderkey = 7 LIMIT 1",
    "status_fold": f"""WITH {_EVENTS}
SELECT id, CASE arg_max(kind, seq) FILTER (kind <> 'retopic') WHEN 'created' THEN 'processing' WHEN 'retried' THEN 'processing' WHEN 'failed' THEN 'error' WHEN 'sent' THEN 'sent' WHEN 'generated' THEN 'draft' WHEN 'saved' THEN 'draft' END AS status,
  arg_max(topic, seq) FILTER (kind IN ('generated', 'retopic')) AS topic, arg_max(topic, seq) FILTER (kind = 'generated') AS original_topic,
  arg_max(confidence, seq) FILTER (kind = 'generated') AS classification_confidence, arg_max(event_type, seq) FILTER (kind = 'generated') AS draft,
  arg_max(event_type, seq) FILTER (kind IN ('saved', 'sent')) AS final, arg_max(es, seq) FILTER (kind = 'sent') AS edit_similarity,
  arg_max(seq % 3 = 0, seq) FILTER (kind = 'generated') AS quality_alert, CAST(arg_max(seq, seq) FILTER (kind = 'generated') AS VARCHAR) AS call_id, arg_max(seq % 5 = 0, seq) FILTER (kind = 'sent') AS operator_edited_topic,
  min(ts) FILTER (kind = 'created') AS created_at, max(ts) AS updated_at, max(ts) FILTER (kind = 'sent') AS sent_at
FROM ev GROUP BY id""",
    "quality_alert": "SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'OK' WHEN toxic = 1 THEN 'NG' END = 'NG', false) AS quality_alert FROM labels",
    "validation_split": "SELECT coalesce(role, '') <> '' AND coalesce(string_split(role, 's')[1], '') <> '' AS is_valid, role IN ('user', 'assistant') AS known_role, count(*) AS n FROM conversations GROUP BY ALL",
    "json_decode": """SELECT event_id, event_id % 3 > 0 AS has_draft, CASE WHEN event_id % 4 > 0 THEN event_type END AS body, CASE WHEN event_id % 5 > 0 THEN event_id % 2 = 1 END AS operator_edited_topic,
  event_id % 7 > 0 AND event_id % 2 = 1 AS quality_alert FROM events""",
    "feedback_kpi": f"""WITH {_EVENTS}
SELECT c.topic, count(*) AS n, round(avg(CAST(f.seq % 3 > 0 AS INT)), 6) AS kept_rate, round(avg(f.es), 6) AS mean_similarity
FROM ev f JOIN ev c ON c.seq = f.seq - 1 AND c.kind = 'generated' WHERE f.kind = 'sent' GROUP BY 1""",
    "classification_accuracy": f"WITH {_PRED} SELECT lang, count(*) AS n, round(avg(CAST(predicted = quality AS INT)), 6) AS accuracy FROM p GROUP BY 1",
    "eval_summary": f"""WITH {_PRED}
SELECT 'classification_accuracy' AS key, round(avg(CAST(predicted = quality AS INT)), 6) AS mean_score, count(*) AS n_scored FROM p
UNION ALL SELECT 'politeness', round(avg(1 - toxic) FILTER (predicted = 1), 6), count(*) FILTER (predicted = 1) FROM p""",
    "dataset_flatten": """SELECT c_name AS customer_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS company_name, CAST(c_custkey AS VARCHAR) AS content,
  CASE WHEN c_custkey % 3 > 0 THEN 'other' END AS expected_topic, CASE WHEN c_custkey % 3 > 0 THEN '' END AS expected_response_body FROM customer""",
    "dataset_latest_version": "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "label_lookup": "SELECT CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Pending' ELSE 'Other' END AS label, count(*) AS n FROM orders GROUP BY 1",
    "format_display": """SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS shown, (o_orderkey % 100) || '%' AS share,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate - to_minutes(CAST(o_orderkey % 500 AS INT)) END AS earlier FROM orders""",
    "coalesce_fallback": """WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_name END AS x FROM customer)
SELECT c_custkey, coalesce(nullif(x, ''), 'none') AS falsy, coalesce(x, 'none') AS nullish, coalesce(x, c_mktsegment, '') AS shown FROM c""",
    "topic_edited": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS t, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS o FROM customer)
SELECT c_custkey, t IS DISTINCT FROM o AS edited, coalesce(t, '') <> '' AND coalesce(o, '') <> '' AS known FROM c""",
    "classify_topics": """WITH c AS (SELECT p_partkey, p_name || ' ' || p_type AS content, lower(p_name || ' ' || p_type) AS low FROM part),
h AS (SELECT *, CAST(contains(low, 'casino') AS INT) + CAST(contains(low, 'lottery') AS INT) + CAST(contains(low, 'seo') AS INT) + CAST(contains(low, 'click here') AS INT) + CAST(contains(low, 'cheap') AS INT) AS s,
  CAST(contains(low, 'develop') AS INT) + CAST(contains(low, 'build') AS INT) + CAST(contains(low, 'system') AS INT) + CAST(contains(low, 'project') AS INT) AS d,
  CAST(contains(low, 'product') AS INT) + CAST(contains(low, 'price') AS INT) + CAST(contains(low, 'license') AS INT) + CAST(contains(low, 'plan') AS INT) AS p FROM c),
t AS (SELECT *, CASE WHEN s > 0 THEN 'spam' WHEN d > 0 THEN 'development' WHEN p > 0 THEN 'product' ELSE 'other' END AS topic,
  round(CASE WHEN s > 0 THEN 0.7::DOUBLE + 0.3::DOUBLE * s / 5 WHEN d > 0 THEN 0.7::DOUBLE + 0.3::DOUBLE * d / 4 WHEN p > 0 THEN 0.7::DOUBLE + 0.3::DOUBLE * p / 4 ELSE 0.5::DOUBLE END, 6) AS confidence FROM h),
b AS (SELECT *, CASE WHEN topic <> 'spam' THEN 'Dear A,' || chr(10) || 'thank you for your inquiry about ' || topic || '. We have received: ' || content END AS body FROM t)
SELECT p_partkey, topic, confidence, body, regexp_matches(coalesce(body, ''), '(?i)\\b(idiot|stupid|shut up|moron)\\b') AS quality_alert FROM b""",
    "upsert_latest": """WITH l AS (SELECT o_custkey AS c_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1)
SELECT c_custkey, c_name, coalesce(o_orderstatus, c_mktsegment) AS c_mktsegment FROM customer FULL JOIN l USING (c_custkey)""",
    "display_index": "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) || '/' || count(*) OVER (PARTITION BY c_nationkey) AS position FROM customer",
}

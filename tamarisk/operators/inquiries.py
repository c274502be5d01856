"""The inquiry table: listing, lookup, validation, and its current state as a fold over append-only events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from tamarisk.functions.scalars import edit_similarity, is_filled, new_inquiry_id, now_utc
from tamarisk.operators.keyed_table import stamped as stamped_change

STATUSES, TOPICS = ("processing", "draft", "sent", "error"), ("product", "development", "other", "spam")
DRAFT = "struct<subject:string,body:string,quality_scores:struct<politeness:string,politeness_reason:string>>"
FINAL = "struct<subject:string,body:string>"
SCHEMA = (
    "id string NOT NULL, customer_name string NOT NULL, customer_email string NOT NULL, company_name string, content string NOT NULL, status string NOT NULL, topic string, original_topic string, "
    f"operator_edited_topic boolean, ai_response {DRAFT}, final_response {FINAL}, classification_confidence double, quality_alert boolean NOT NULL, edit_distance double, weave_call_id string, "
    "created_at timestamp NOT NULL, updated_at timestamp NOT NULL, sent_at timestamp"
)
STATUS_LABELS = {"processing": "Processing", "draft": "Draft", "sent": "Sent", "error": "Error"}


def create_table(spark, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet")


def stamped(df: DataFrame, now: Column) -> DataFrame:
    """Rows as new inquiries: all columns of the table; id, status, alert and times have their defaults where they are missing or null."""
    given = {c.lower() for c in df.columns}
    defaults = {"id": new_inquiry_id(), "status": F.lit("processing"), "quality_alert": F.lit(False), "created_at": now, "updated_at": now}
    kinds = _parse_datatype_string(SCHEMA)
    value = lambda f: F.col(f.name) if f.name in given else F.lit(None).cast(f.dataType)
    return df.select(*[(F.coalesce(value(f), defaults[f.name]) if f.name in defaults else value(f)).cast(f.dataType).alias(f.name) for f in kinds])


def insert(df: DataFrame, path: str, now: Column | None = None) -> None:
    """Append one row or many at once: Spark's commit makes all of them visible or none."""
    stamped(df, now_utc() if now is None else now).write.mode("append").parquet(path)


def delete_all(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)


def is_confidence(x: Column) -> Column:
    """From 0 to 1; null is not."""
    return F.coalesce(x.between(0, 1), F.lit(False))


def matches(filters: dict[str, object]) -> Column:
    """Equality on every given column; None and 'all' stand for no condition."""
    given = [F.col(c) == v for c, v in filters.items() if v is not None and v != "all"]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def page(df: DataFrame, columns: list[str], filters: dict[str, object], newest: str, key: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest rows first; rows of the same time by key."""
    return df.where(matches(filters)).select(*columns).orderBy(F.desc(newest), key).offset(offset).limit(limit)


def count(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    return df.where(matches(filters)).agg(F.count("*").alias("total"))


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def quality_alert(politeness: Column) -> Column:
    """True only where a draft was judged NG."""
    return F.coalesce(politeness == "NG", F.lit(False))


def topic_edited(topic: Column, original: Column) -> Column:
    """Two missing topics are the same."""
    return ~topic.eqNullSafe(original)


def shown_text(final: Column, draft: Column) -> Column:
    return F.coalesce(final, draft, F.lit(""))


def validate(df: DataFrame, required: list[str]) -> DataFrame:
    """Adds is_valid: no required field is null or empty."""
    return df.withColumn("is_valid", reduce(lambda a, b: a & b, [is_filled(F.col(c)) for c in required], F.lit(True)))


def send_metrics(ai_body: Column, final_body: Column, original: Column, topic: Column, call_id: Column) -> Column:
    """{operator_edited_topic, edit_similarity}; the similarity is null unless call, original topic and topic are all filled."""
    known = is_filled(call_id) & is_filled(original) & is_filled(topic)
    return F.struct(topic_edited(topic, original).alias("operator_edited_topic"), F.when(known, edit_similarity(ai_body, final_body)).alias("edit_similarity"))


def decode(df: DataFrame) -> DataFrame:
    """Stored text and integers as structs and booleans; empty JSON is null."""
    return df.withColumns({
        "ai_response": F.from_json(F.nullif("ai_response", F.lit("")), DRAFT), "final_response": F.from_json(F.nullif("final_response", F.lit("")), FINAL),
        "operator_edited_topic": F.col("operator_edited_topic").cast("boolean"), "quality_alert": F.coalesce(F.col("quality_alert").cast("boolean"), F.lit(False)),
    })


def fold(events: DataFrame) -> DataFrame:
    """Current state of each inquiry from events (id, seq, kind, topic, confidence, draft, final, edit_similarity, at).

    Events may also carry quality_alert and call_id, which a generated draft sets, and operator_edited_topic, which sending sets.
    Kinds: created, generated, failed, retried, saved, retopic, sent. The latest event of a kind that sets a column wins; a
    generated draft sets topic and original topic, also after an operator changed it, and keeps the final text.
    """
    status = F.create_map(*[F.lit(x) for p in {"created": "processing", "generated": "draft", "failed": "error", "retried": "processing", "saved": "draft", "sent": "sent"}.items() for x in p])
    kind = F.col("kind")
    last = lambda c, *kinds: F.max_by(F.col(c), F.when(kind.isin(*kinds), F.col("seq"))) if kinds else F.max_by(F.col(c), "seq")
    more = [last(c, kind_of).alias(c) for c, kind_of in (("quality_alert", "generated"), ("call_id", "generated"), ("operator_edited_topic", "sent")) if c in events.columns]
    return events.groupBy("id").agg(
        *more, F.max_by(status[kind], F.when(kind != "retopic", F.col("seq"))).alias("status"), last("topic", "generated", "retopic").alias("topic"), last("topic", "generated").alias("original_topic"),
        last("confidence", "generated").alias("classification_confidence"), last("draft", "generated").alias("draft"), last("final", "saved", "sent").alias("final"),
        last("edit_similarity", "sent").alias("edit_similarity"), F.min(F.when(kind == "created", F.col("at"))).alias("created_at"), F.max("at").alias("updated_at"), F.max(F.when(kind == "sent", F.col("at"))).alias("sent_at"),
    )


def apply_updates(current: DataFrame, updates: DataFrame, key: str = "id", sets: tuple[str, ...] = ()) -> DataFrame:
    """Keyed upsert: columns of updates replace those of current where not null, those named in sets also where null; new keys
    are added. Columns that an update lacks are null in new rows."""
    changed = [c for c in updates.columns if c != key]
    u = updates.select(F.col(key), F.lit(True).alias("_there"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = current.join(u, key, "full")
    new = lambda c: F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in sets else F.coalesce(f"_new_{c}", c)
    return joined.select(*[new(c).alias(c) if c in changed else F.col(c) for c in current.columns])


#: How the columns of an inquiry's state merge in a keyed table, and their types.
STATE_MERGES = {c: "last" for c in ("status", "topic", "original_topic", "classification_confidence", "draft", "final", "edit_similarity", "quality_alert", "call_id", "operator_edited_topic")} | {"created_at": "min", "updated_at": "max", "sent_at": "max"}
STATE = (
    "id long, status string, topic string, original_topic string, classification_confidence double, draft string, final string, edit_similarity double, created_at timestamp_ntz, updated_at timestamp_ntz, sent_at timestamp_ntz, "
    "quality_alert boolean, call_id string, operator_edited_topic boolean"
)


def state_changes(events: DataFrame) -> DataFrame:
    """What each event changes, for a keyed table: merged, these changes are the fold of the events."""
    status = F.create_map(*[F.lit(x) for p in {"created": "processing", "generated": "draft", "failed": "error", "retried": "processing", "saved": "draft", "sent": "sent"}.items() for x in p])
    kind = F.col("kind")
    change = lambda value, use: stamped_change(value, F.when(use, F.col("seq")))
    by_kind = {
        "topic": ("generated", "retopic"), "original_topic": ("generated",), "classification_confidence": ("generated",), "draft": ("generated",), "final": ("saved", "sent"), "edit_similarity": ("sent",), "quality_alert": ("generated",),
        "call_id": ("generated",), "operator_edited_topic": ("sent",),
    }
    source = {"original_topic": "topic", "classification_confidence": "confidence"}
    columns = [change(F.col(source.get(c, c)), kind.isin(*kinds)).alias(c) for c, kinds in by_kind.items()]
    times = [F.when(kind == "created", F.col("at")).alias("created_at"), F.col("at").alias("updated_at"), F.when(kind == "sent", F.col("at")).alias("sent_at")]
    return events.select("id", change(status[kind], kind != "retopic").alias("status"), *columns, *times)

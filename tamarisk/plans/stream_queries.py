"""Streams that run over all there is and then end; their last state is the result."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.sources.files import latest_row
from tamarisk.sources.tables import load, work_dir
from tamarisk.streaming.threads import enrich_stream, thread_states, windowed_counts


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that keyed state needs."""
    key, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, wanted)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream, be it a folder of part files or one file, which a stream can only find by its name."""
    own = f"{sf_dir}/{name}.parquet"
    rows = spark.readStream.schema(load(spark, sf_dir, name).schema)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return rows.parquet(own)
    return rows.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def kept(rows: DataFrame, mode: str, folder: str) -> None:
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def thread_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "threads")
    events = stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("thread_id"), F.col("event_id").alias("seq"), "event_type")
    with rocksdb(spark):
        kept(thread_states(events), "update", folder)
    return latest_row(spark.read.parquet(f"{folder}/out"), ["thread_id"], "batch", []).select("thread_id", "n_events", "state")


def inquiry_enrich_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as inquiries: topics and drafts by micro-batches."""
    folder = work_dir(spark, "inquiries")
    rows = stream(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("A").alias("customer_name"), F.lit("").alias("company_name"), F.concat_ws(" ", "p_name", "p_type").alias("content"))
    enrich_stream(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", "topic", F.col("draft.subject").alias("subject"), "quality_alert")


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type, as an updated stream leaves them."""
    folder = work_dir(spark, "windows")
    kept(windowed_counts(stream(spark, sf_dir, "events"), width="1 hour"), "update", folder)
    last = latest_row(spark.read.parquet(f"{folder}/out"), ["window", "event_type"], "batch", [])
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("started"), "event_type", "n")


QUERIES = {f.__name__: f for f in (thread_state_stream, inquiry_enrich_stream, windowed_events)}
SQL = {
    "thread_state_stream": """SELECT CAST(user_id AS VARCHAR) AS thread_id, count(*) AS n_events, CASE arg_max(event_type, event_id) FILTER (event_type IN ('click', 'purchase', 'view')) WHEN 'click' THEN 'waiting' WHEN 'purchase' THEN 'approved' WHEN 'view' THEN 'rejected' END AS state
FROM events GROUP BY 1""",
    "inquiry_enrich_stream": """WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS id, lower(p_name || ' ' || p_type) AS low, p_name || ' ' || p_type AS content FROM part),
t AS (SELECT *, CASE WHEN regexp_matches(low, 'casino|lottery|seo|click here|cheap') THEN 'spam' WHEN regexp_matches(low, 'develop|build|system|project') THEN 'development'
  WHEN regexp_matches(low, 'product|price|license|plan') THEN 'product' ELSE 'other' END AS topic FROM c)
SELECT id, topic, CASE WHEN topic <> 'spam' THEN 'Re: ' || topic END AS subject, topic <> 'spam' AND regexp_matches(content, '(?i)\\b(idiot|stupid|shut up|moron)\\b') AS quality_alert FROM t""",
    "windowed_events": "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}

"""Conversation threads and inquiries as streams: keyed state, interrupts, and enrichment by micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tamarisk.functions.models import model
from tamarisk.operators.inquiries import quality_alert

#: Event types as steps of a reviewed call: asked, approved, rejected. Others leave the state as it is.
STEPS = {"click": "waiting", "purchase": "approved", "view": "rejected"}
STATES = "thread_id string, n_events long, state string"


def batch_states(events: DataFrame) -> DataFrame:
    """The state of each thread after all events (thread_id, seq, event_type)."""
    step = F.create_map(*[F.lit(x) for p in STEPS.items() for x in p])[F.col("event_type")]
    return events.withColumn("step", step).groupBy("thread_id").agg(F.count("*").alias("n_events"), F.max_by("step", F.when(F.col("step").isNotNull(), F.col("seq"))).alias("state"))


class ThreadProcessor(StatefulProcessor):
    """Keeps the latest step of each thread, by sequence number, across micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "n long, seq long, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, seq, state = self.held.get() if self.held.exists() else (0, -1, None)
        for batch in rows:
            n += len(batch)
            steps = batch[batch["event_type"].isin(list(STEPS)) & (batch["seq"] > seq)]
            if len(steps):
                last = steps.loc[steps["seq"].idxmax()]
                seq, state = int(last["seq"]), STEPS[last["event_type"]]
        self.held.update((n, seq, state))
        yield pd.DataFrame({"thread_id": [key[0]], "n_events": [n], "state": [state]})

    def close(self) -> None:
        pass


def thread_states(events: DataFrame) -> DataFrame:
    """A stream of events to a stream of thread states; needs the RocksDB state store."""
    return events.groupBy("thread_id").transformWithStateInPandas(ThreadProcessor(), STATES, "update", "none")


def enriched(inquiries: DataFrame) -> DataFrame:
    """Classified inquiries (id, content, …) with drafts; spam has none. The filter stands before the drafting, so that it
    runs for the others only."""
    judged = inquiries.withColumn("_t", model("classify_topic")(F.col("content"))).withColumns({"topic": F.col("_t.topic"), "confidence": F.col("_t.confidence")}).drop("_t")
    others = judged.where("topic <> 'spam'").withColumn("draft", model("generate_response")(F.col("topic"), F.col("customer_name"), F.col("company_name"), F.col("content")))
    others = others.withColumn("quality_alert", quality_alert(model("check_quality")(F.col("draft.body"))["politeness"]))
    return others.unionByName(judged.where("topic = 'spam'").withColumn("quality_alert", F.lit(False)), allowMissingColumns=True)


def outcome(rows: DataFrame) -> DataFrame:
    """Enriched inquiries with the status of their job: error where a model function gave no topic, or no draft for what is no
    spam; else draft."""
    failed = F.col("topic").isNull() | (F.col("topic") != "spam") & F.col("draft").isNull()
    return rows.withColumn("status", F.when(failed, "error").otherwise("draft"))


def job(inquiries: DataFrame) -> DataFrame:
    """All of a batch through the models: those without content can't be judged and end as errors, the others go on."""
    good = outcome(enriched(inquiries.where("content IS NOT NULL"))).withColumn("error", F.lit(None).cast("string"))
    bad = inquiries.where("content IS NULL").withColumns({"status": F.lit("error"), "error": F.lit("no content")})
    return good.unionByName(bad, allowMissingColumns=True)


def enrich_stream(stream: DataFrame, path: str, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None, every: str | None = None):
    """Each micro-batch is enriched and appended; a batch that is run again after a failure replaces its own files. Without
    every (such as "5 seconds") the stream takes all there is and ends."""

    def default(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return stream.writeStream.foreachBatch(write or default).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def windowed_counts(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per window and type; rows later than the delay are left out once their window is closed."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"))

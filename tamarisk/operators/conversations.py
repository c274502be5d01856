"""Message histories: last messages, suffixes, tool calls and token streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.scalars import characters


def last_message(df: DataFrame, by: str = "conv_id", turn: str = "turn", *columns: str) -> DataFrame:
    """Of each conversation the columns of its last turn."""
    return df.groupBy(by).agg(F.max(turn).alias(turn), *[F.max_by(c, turn).alias(c) for c in columns])


def last_state(df: DataFrame, by: str, order: str, value: Column) -> DataFrame:
    """The last value that is not null."""
    return df.withColumn("_v", value).groupBy(by).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("state"))


def messages_since(df: DataFrame, n: int, turn: str = "turn") -> DataFrame:
    return df.where(F.col(turn) >= n)


def token_stream(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """A row for each character: the keys, seq from 0, token."""
    return df.select(*keys, F.posexplode(characters(F.coalesce(F.col(text), F.lit("")))).alias("seq", "token"))


def accumulated(tokens: DataFrame, *keys: str) -> DataFrame:
    """Token events back to text, in order of seq."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"])
    return tokens.groupBy(*keys).agg(F.array_join(ordered, "").alias("text"))


def dispatched(calls: DataFrame, tools: DataFrame, name: str = "name") -> DataFrame:
    """Calls with the tool of their name; tools is a small registry."""
    return calls.join(tools, name, "left")


def unanswered(calls: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    return calls.join(results, on, "left_anti")


def rejections(calls: DataFrame, feedback: str) -> DataFrame:
    """An error message for every pending call (thread_id, tool_call_id), then the feedback as a user message."""
    errors = calls.select("thread_id", "tool_call_id", F.lit("tool").alias("role"), F.lit("error").alias("status"), F.lit("rejected").alias("content"))
    said = calls.select("thread_id").distinct().select("thread_id", F.lit(None).cast("string").alias("tool_call_id"), F.lit("user").alias("role"), F.lit(None).cast("string").alias("status"), F.lit(feedback).alias("content"))
    return errors.unionByName(said)

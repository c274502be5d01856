"""Agents over batches of threads: calls, the loop of model and tools, nested agents, and stage and custom events.

Messages are rows (thread_id, seq, role, content, calls), calls an array of {id, name, args}.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.sources.tables import work_dir

CALLS = "array<struct<id:string,name:string,args:string>>"
MESSAGES = f"thread_id string, seq long, role string, content string, calls {CALLS}"


def has_calls(calls: Column) -> Column:
    """Whether a message asks for tools; none and no list are the same."""
    return F.coalesce(F.size(calls) > 0, F.lit(False))


def called(name: Column, args: Column, tools: dict[str, Callable[[Column], Column]]) -> Column:
    """The result of each call; an unknown tool gives an error text."""
    out = F.concat(F.lit("unknown tool: "), F.coalesce(name, F.lit("")))
    for tool, run in tools.items():
        out = F.when(name == tool, run(args).cast("string")).otherwise(out)
    return out


Model = Callable[[Column, Column], Column]
Tools = dict[str, Callable[[Column], Column]]


@dataclass(frozen=True)
class Agent:
    """A model with tools and agents of its own; as an agent of another it is asked like a tool, and answers with its last words."""

    model: Model
    tools: Tools = field(default_factory=dict)
    agents: dict[str, Agent] = field(default_factory=dict)
    rounds: int = 10


def _by_agents(calls: DataFrame, agents: dict[str, Agent]) -> DataFrame:
    """calls (thread_id, seq, i, c) with answer: what the agent that a call names says in the end, in a thread of its own; null
    for calls of tools. An agent that is not done within its rounds has an answer that says so."""
    own = F.concat_ws("/", "thread_id", F.col("seq"), F.col("i"))
    answers = None
    for name, agent in agents.items():
        asked = calls.where(F.col("c.name") == name).select(own.alias("thread_id"), F.lit(0).cast("long").alias("seq"), F.lit("user").alias("role"), F.col("c.args").alias("content"), F.lit(None).cast(CALLS).alias("calls"))
        done = tool_loop(asked, agent.model, agent.tools, agent.rounds, agent.agents)
        ended = thread_status(done).select("thread_id", F.when(F.col("status") == "done", F.coalesce("content", F.lit(""))).otherwise(F.concat(F.lit(f"{name}: not done after rounds: "), F.lit(agent.rounds).cast("string"))).alias("answer"))
        answers = ended if answers is None else answers.unionByName(ended)
    return calls.withColumn("own", own).join(answers.withColumnRenamed("thread_id", "own"), "own", "left").drop("own")


def tool_loop(messages: DataFrame, model: Model, tools: Tools, rounds: int = 10, agents: dict[str, Agent] | None = None) -> DataFrame:
    """Messages with all that follows until no thread asks for a tool, or after so many rounds; thread_status tells which threads
    are not done then.

    Threads whose last message is a user's or a tool's are answered; model(content of the last message, number of tool
    results so far) gives {content, calls}. Every call gets a tool message: a tool's result, or the answer of an agent of that
    name. A round is one plan for all threads; what it adds is written to the shared folder, so a lost executor costs no
    earlier round. From round to round only each thread's last message and counts are carried on.
    """
    spark, folder = messages.sparkSession, work_dir(messages.sparkSession, "agents")
    have = messages
    heads = messages.groupBy("thread_id").agg(F.max_by(F.struct("role", "content"), "seq").alias("last"), F.max("seq").alias("seq"), F.count_if(F.col("role") == "tool").alias("n"))
    for number in range(rounds):
        asked = heads.where("last.role IN ('user', 'tool')").withColumn("m", model(F.col("last.content"), F.col("n")))
        answers = asked.select("thread_id", (F.col("seq") + 1).alias("seq"), F.lit("assistant").alias("role"), "m.content", F.col("m.calls").cast(CALLS).alias("calls"))
        answers.write.parquet(f"{folder}/{number}/answers")
        answers = spark.read.schema(MESSAGES).parquet(f"{folder}/{number}/answers")
        calls = answers.where(has_calls(F.col("calls"))).select("thread_id", "seq", F.posexplode("calls").alias("i", "c"))
        result = called(F.col("c.name"), F.col("c.args"), tools)
        if agents:
            calls, result = _by_agents(calls, agents), F.coalesce("answer", result)
        results = calls.select("thread_id", (F.col("seq") + 1 + F.col("i")).alias("seq"), F.lit("tool").alias("role"), result.alias("content"), F.lit(None).cast(CALLS).alias("calls"))
        results.write.parquet(f"{folder}/{number}/results")
        results = spark.read.schema(MESSAGES).parquet(f"{folder}/{number}/results")
        have = have.unionByName(answers).unionByName(results)
        if results.isEmpty():
            break
        # threads that got results go on; the others are done
        more = results.groupBy("thread_id").agg(F.max_by(F.struct("role", "content"), "seq").alias("last"), F.max("seq").alias("seq"), F.count("*").alias("more"))
        (more.join(heads.select("thread_id", "n"), "thread_id").select("thread_id", "last", "seq", (F.col("n") + F.col("more")).alias("n"))).write.parquet(f"{folder}/{number}/heads")
        heads = spark.read.parquet(f"{folder}/{number}/heads")
    return have


def thread_status(messages: DataFrame) -> DataFrame:
    """thread_id, status, content of the last message: `done` if that is an assistant's without calls, else `open` (a call without
    result, or a message without an answer)."""
    last = messages.groupBy("thread_id").agg(F.max_by(F.struct("role", "content", "calls"), "seq").alias("m"))
    done = F.coalesce(F.col("m.role") == "assistant", F.lit(False)) & ~has_calls(F.col("m.calls"))
    return last.select("thread_id", F.when(done, "done").otherwise("open").alias("status"), "m.content")


def final_content(messages: DataFrame) -> DataFrame:
    """What an agent gives to the one that calls it: the content of each thread's last message."""
    return messages.groupBy("thread_id").agg(F.max_by("content", "seq").alias("content"))


def staged(stages: dict[str, DataFrame], key: str, custom: dict[str, Column] | None = None) -> DataFrame:
    """Updates of named stages as events (key, stage, kind, payload): the stage's row as JSON; and custom events, where a
    stage emits some: an expression over its rows, null for none."""
    rows = []
    for name, df in stages.items():
        rows.append(df.select(key, F.lit(name).alias("stage"), F.lit("update").alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("payload")))
        if custom and name in custom:
            rows.append(df.select(key, F.lit(name).alias("stage"), F.lit("custom").alias("kind"), custom[name].alias("payload")).where("payload IS NOT NULL"))
    return reduce(DataFrame.unionByName, rows)


def of_kinds(events: DataFrame, *kinds: str) -> DataFrame:
    return events.where(F.col("kind").isin(*kinds))


def changed(questions: DataFrame, answered: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """Questions whose text isn't the one that was answered: what has to run again."""
    before = answered.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return questions.join(before, (F.col(key) == F.col("_key")) & F.col(text).eqNullSafe(F.col("_text")), "left_anti")

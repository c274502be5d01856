"""Streams of calls against their batch forms and at the edges; versions of datasets; calls tried row by row."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tamarisk.plans.stream_queries import kept, rocksdb
from tamarisk.sources import versions
from tamarisk.sources.files import latest_row
from tamarisk.streaming import attempts, calls

HOUR = 3_600_000
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def streamed(spark, tmp_path, name, batches, schema):
    """Rows as a stream that takes one file a batch, in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}-{i}"))
    (tmp_path / name).mkdir()
    for i in range(len(batches)):
        for f in (tmp_path / f"{name}-{i}").glob("*.parquet"):
            target = tmp_path / name / f"{i:03d}.parquet"
            f.rename(target)
            import os

            os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


EVENTS = "thread_id string, seq long, kind string, ts timestamp"


def review_rows(seed):
    r = random.Random(seed)
    return [(f"t{r.randrange(4)}", i, r.choice(("ask", "ask", "approve", "reject", "other")), START + dt.timedelta(minutes=37 * (i // 2))) for i in range(120)]


@pytest.mark.parametrize("order", ["as they come", "shuffled"])
def test_reviews_in_any_order(spark, tmp_path, order):
    rows = review_rows(3)
    given = list(rows)
    if order == "shuffled":
        random.Random(1).shuffle(given)
    delay = "90 days" if order == "shuffled" else "10 minutes"
    with rocksdb(spark):
        kept(calls.reviews(streamed(spark, tmp_path, "e", [given[i::3] if order == "shuffled" else given[40 * i : 40 * i + 40] for i in range(3)], EVENTS), 2 * HOUR, delay), "update", str(tmp_path / "w"))
    got = latest_row(spark.read.parquet(str(tmp_path / "w/out")), ["thread_id", "call_id"], "batch", [])
    reached = max(r[3] for r in rows if r[2] != "other") - (dt.timedelta(days=90) if order == "shuffled" else dt.timedelta(minutes=10))
    want = calls.batch_reviews(spark.createDataFrame(rows, EVENTS), 2 * HOUR, int(reached.timestamp() * 1000))
    of = lambda df: sorted((r.thread_id, r.call_id, r.state, r.decided_by) for r in df.collect())
    assert of(got) == of(want)
    states = {r[2] for r in of(want)}
    assert states >= {"approved", "rejected", "waiting"} and (order == "shuffled" or "expired" in states)


def test_a_rejection_is_on_every_open_call(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [("a", 1, "ask", at(0)), ("a", 2, "ask", at(1)), ("a", 3, "reject", at(2)), ("a", 4, "ask", at(3)), ("a", 5, "approve", at(200)), ("b", 6, "ask", at(0)), (None, 7, "ask", at(0)), ("a", 8, "ask", None)]
    got = {r.call_id: (r.state, r.decided_by) for r in calls.batch_reviews(spark.createDataFrame(rows, EVENTS).where("ts IS NOT NULL"), HOUR, int(at(120).timestamp() * 1000)).collect()}
    assert got == {1: ("rejected", 3), 2: ("rejected", 3), 4: ("expired", None), 6: ("expired", None), 7: ("expired", None)}


def test_tokens_in_order(spark, tmp_path):
    schema = "key string, i long, token string"
    text = [f"{'' if i else 'Start '}w{i} " for i in range(60)]
    r = random.Random(2)
    rows = [("a", i, t) for i, t in enumerate(text)] * 2 + [("b", 1, "later"), ("b", 3, "never"), ("c", 0, None), (None, 0, "x"), ("d", None, "x")]
    r.shuffle(rows)
    rows.append(("b", 0, "first "))
    with rocksdb(spark):
        kept(calls.token_pieces(streamed(spark, tmp_path, "t", [rows[:50], rows[50:90], rows[90:]], schema)), "append", str(tmp_path / "w"))
    pieces = {}
    for x in spark.read.parquet(str(tmp_path / "w/out")).orderBy("key", "first").collect():
        pieces.setdefault(x.key, []).append((x.first, x.n, x.text))
    assert "".join(t for _, _, t in pieces["a"]) == "".join(text) and "".join(t for _, _, t in pieces["b"]) == "first later" and set(pieces) == {"a", "b", "c"}
    assert [f for f, _, _ in pieces["a"]] == [sum(n for _, n, _ in pieces["a"][:k]) for k in range(len(pieces["a"]))]


def test_calls_without_feedback_come_once(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    asked = streamed(spark, tmp_path, "c", [[(1, at(0)), (2, at(1)), (None, at(1))], [(3, at(500)), (4, at(600))]], "call long, at timestamp")
    fed = streamed(spark, tmp_path, "f", [[(1, "x", at(30)), (9, "z", at(31))], [(1, "y", at(40)), (2, "late", at(400)), (4, "x", at(610))]], "call long, said string, at timestamp")
    kept(calls.feedback_joined(asked, fed, "1 HOUR", "10 minutes"), "append", str(tmp_path / "w"))
    got = sorted((r.call or 0, r.said or "") for r in spark.read.parquet(str(tmp_path / "w/out")).collect())
    assert got == [(0, ""), (1, "x"), (1, "y"), (2, ""), (3, ""), (4, "x")]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = spark.createDataFrame([(i, f"r{i % 7}") for i in range(500)] + [(1, "r1"), (None, None)], "k int, v string")
    assert versions.publish(rows, path, "a") == 1
    changed = rows.where("k <> 17 OR k IS NULL").union(spark.createDataFrame([(900, "new"), (900, "new"), (1, "r1")], "k int, v string"))
    assert versions.publish(changed, path, "a") == 2 and versions.publish(rows.limit(0), path, "empty") == 1
    found, read = versions.difference(spark, path, "a", 1, 2)
    assert sorted(map(tuple, found.collect())) == [(1, "r1", "added"), (17, "r3", "removed"), (900, "new", "added"), (900, "new", "added")] and 1 <= len(read) <= 3
    assert versions.difference(spark, path, "a", 1, 1)[1] == [] and versions.difference(spark, path, "a", 1, 1)[0].count() == 0
    assert sorted(map(str, versions.read(spark, path, "a", 1).collect())) == sorted(map(str, rows.collect())) and versions.read(spark, path, "empty").count() == 0
    one, two = (set(versions.manifest(spark, path, "a", n)["folders"].items()) for n in (1, 2))
    assert len(one & two) >= len(one) - 3  # what did not change is not written again
    assert versions.publish(changed, path, "a") == 3 and versions.manifest(spark, path, "a", 3)["folders"] == versions.manifest(spark, path, "a", 2)["folders"]
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, path, "a", 9)
    with pytest.raises(ValueError, match="other columns"):
        versions.publish(rows.select("k"), path, "a")
        versions.difference(spark, path, "a", 3, 4)


def test_trees():
    leaves = [str(i) for i in range(64)]
    other = [*leaves[:9], "x", *leaves[10:63], "y"]
    assert versions.differing(versions.tree(leaves), versions.tree(other)) == [9, 63] and versions.differing(versions.tree(leaves), versions.tree(list(leaves))) == []


def test_attempts(spark, tmp_path):
    rows = spark.createDataFrame([(i, "old", f"c{i}") for i in range(6)] + [(None, None, None)], "id long, error string, content string").repartition(2)

    def call(row, number):
        if row["id"] == 1:
            raise ValueError("never " + "x" * 1_000)
        if row["id"] == 2 and number < 3:
            raise RuntimeError("soon")
        if row["id"] == 3:
            return {"n": "no number"}
        return None if row["id"] == 4 else {"n": len(row["content"] or "")}

    got = {r.id: (r.result and r.result.n, r.attempts, r.error and r.error[:12]) for r in attempts.attempted(rows, call, "n long").collect()}
    assert got[0] == (2, 1, None) and got[1] == (None, 3, "ValueError: ") and got[2] == (2, 3, None) and got[3][:2] == (None, 3) and got[4] == (None, 1, None) and got[None] == (0, 1, None)
    assert attempts.attempted(rows.limit(0), call, "n long").count() == 0
    stream = streamed(spark, tmp_path, "r", [[(i, f"c{i}") for i in range(3)], [(i, f"c{i}") for i in range(3, 6)]], "id long, content string")
    attempts.attempt_stream(stream, str(tmp_path / "out"), str(tmp_path / "c"), call, "n long").awaitTermination()
    dead = attempts.dead_letters(spark, str(tmp_path / "out"))
    assert sorted(r.id for r in dead.collect()) == [1, 3] and attempts.outcomes(spark, str(tmp_path / "out")).count() == 6
    again = attempts.attempted(dead, lambda row, number: {"n": 1}, "n long")
    assert all(r.error is None and r.result.n == 1 for r in again.collect())

"""Sorted tables, call trees and kept answers: against plain forms, at the edges, and what they read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tamarisk.operators.sorted_table import SortedTable
from tamarisk.operators.spans import subtree_totals
from tamarisk.plans.answer_cache import AnswerCache
from tamarisk.plans.chains import create_chain
from tamarisk.sources import versions

START = dt.datetime(2024, 1, 1)


def test_pages_by_the_last_row(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, r.choice(("a", "a", "b", None)), START + dt.timedelta(hours=r.randrange(60)) if r.random() < 0.9 else None) for i in range(400)]
    table = SortedTable(spark, str(tmp_path / "t"), "status", "at", "id")
    table.build(spark.createDataFrame(rows, "id long, status string, at timestamp_ntz"), 12)
    for value in ("a", "b", None, "none"):
        own = [x for x in rows if x[1] == value]
        want = sorted((x for x in own if x[2]), key=lambda x: (-x[2].timestamp(), x[0])) + sorted((x for x in own if not x[2]), key=lambda x: x[0])
        got, after = [], None
        while page := table.page(value, 17, after).collect():
            assert table.read < table.of_files or value == "a"
            got += [(x.id, x.status, x["at"]) for x in page]
            after = (page[-1]["at"], page[-1].id)
        assert got == want
    first = table.page("a", 5).collect()
    assert len(first) == 5 and table.read <= 2 and table.of_files >= 8


def test_keys_by_their_filters(spark, tmp_path):
    rows = [(i, "s", START + dt.timedelta(minutes=i * 7919 % 10_000)) for i in range(3_000)] + [(5, "s", START), (None, "s", START)]
    table = SortedTable(spark, str(tmp_path / "t"), "status", "at", "id")
    table.build(spark.createDataFrame(rows, "id long, status string, at timestamp_ntz"), 10)
    read = []
    for key in (0, 7, 2_999):
        assert [x.id for x in table.lookup(key).collect()] == [key]
        read.append(table.read)
    assert sum(read) <= 6 and table.lookup(5).count() == 2 and table.lookup(77_777).count() == 0 and table.of_files >= 8


def test_subtree_totals(spark):
    r = random.Random(3)
    parent = {i: (None if i % 50 == 0 else r.randrange(i - i % 50, i)) for i in range(200)} | {i: i - 1 for i in range(201, 300)} | {200: 999, 300: None}
    cost = {i: r.choice((None, 1, 5, 20)) for i in parent}
    got = {x.span_id: (x.parent_id, x.depth, x.n_spans, x.cost) for x in subtree_totals(spark.createDataFrame([(i, p, cost[i]) for i, p in parent.items()], "span_id long, parent_id long, cost long"), ["cost"]).collect()}
    depth, count, total = {}, {i: 0 for i in parent}, {i: 0 for i in parent}
    for i in parent:
        at, depth[i] = i, -1
        while at in parent:
            count[at], total[at], depth[i] = count[at] + 1, total[at] + (cost[i] or 0), depth[i] + 1
            at = parent[at]
    assert got == {i: (p if p in parent else None, depth[i], count[i], total[i]) for i, p in parent.items()}
    assert subtree_totals(spark.createDataFrame([], "span_id long, parent_id long, cost long"), ["cost"]).count() == 0


def test_circles_of_spans(spark, monkeypatch):
    from tamarisk.operators import spans

    monkeypatch.setattr(spans, "ROUNDS", 4)
    with pytest.raises(ValueError, match="circle"):
        subtree_totals(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "span_id long, parent_id long"), [])


def test_kept_answers(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i % 5} own{i}") for i in range(20)], "doc_id long, text string")
    corpora = str(tmp_path / "corpora")
    versions.publish(docs, corpora, "c")
    cache = AnswerCache(spark, str(tmp_path / "answers"), corpora)
    asked = spark.createDataFrame([(1, "word1 own1"), (2, "own7"), (3, "own7"), (4, "nowhere"), (5, None), (6, "common")], "query_id long, text string")
    of = lambda df: sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in df.select("query_id", "doc_id", "score", "rank").collect())
    flags = lambda df: {r.query_id: r.cached for r in df.collect()}
    first = cache.ask(asked, "naive", "c")
    assert of(first) == of(create_chain("naive")(asked, docs)) and not any(flags(first).values())
    assert all(flags(cache.ask(asked, "naive", "c")).values())
    changed = docs.where("doc_id <> 6").union(spark.createDataFrame([(50, "word2 fresh"), (51, "own7 nowhere")], "doc_id long, text string"))
    versions.publish(changed, corpora, "c")
    second = cache.ask(asked, "naive", "c")
    assert of(second) == of(create_chain("naive")(asked, changed))
    assert flags(second) == {1: False, 2: False, 3: False, 4: False, 6: False}  # document 6 held word1 and common
    versions.publish(changed.where("doc_id <> 13"), corpora, "c")
    assert flags(cache.ask(asked, "naive", "c")) == {1: True, 2: True, 3: True, 4: True, 6: False}
    old = cache.ask(asked.where("query_id = 6"), "naive", "c", 1)
    assert of(old) == of(create_chain("naive")(asked.where("query_id = 6"), docs))
    with pytest.raises(ValueError, match="depend on all"):
        cache.ask(asked, "hybrid", "c")

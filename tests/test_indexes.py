"""Stored indexes and the keyed table: against scans and folds, at the edges, and what they read and rewrite."""

import os
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarisk.operators import inquiries, postings, vector_index
from tamarisk.operators.keyed_table import KeyedTable, stamped, write_once
from tamarisk.operators.retrieve import Corpus, vector_top_k

rows_of = lambda df: sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in df.collect())


def vectors(seed, n, groups, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 8)) * 10
    return [(i, (centres[i % groups] + rng.normal(size=8) * spread).tolist()) for i in range(n)]


def test_vector_index_reads_few_cells_of_clustered_rows(spark, tmp_path):
    rows = spark.createDataFrame(vectors(1, 3_000, 40, 0.3), "vec_id long, embedding array<double>").repartition(3)
    vector_index.build(rows, str(tmp_path / "i"), cells=60)
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"))
    asked = rows.where("vec_id < 60")
    assert rows_of(index.search(asked, 3)) == rows_of(vector_top_k(asked, rows, 3))
    one = rows.where("vec_id = 7")
    assert rows_of(index.search(one, 3)) == rows_of(vector_top_k(one, rows, 3))
    assert index.read[0]["cells"] <= 10 and index.read[0]["rows"] < 1_000 and index.read[0]["of_rows"] == 3_000


def test_vector_index_at_the_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "FILE_ROWS", 20)
    monkeypatch.setattr(vector_index, "DISTANCES", 64)
    rows = [*vectors(2, 100, 100, 1.0), *[(200 + i, [1.0, *[0.0] * 7]) for i in range(60)], (300, None), (301, [0.0] * 8), (5, [3.0] * 8), (None, [2.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    vector_index.build(table, str(tmp_path / "i"), cells=7)
    asked = table.where("vec_id IN (3, 4, 200, 300, 301)")
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"))
    assert rows_of(index.search(asked, 4)) == rows_of(vector_top_k(asked, table.where("vec_id IS NOT NULL"), 4))
    assert index.search(asked.limit(0)).count() == 0
    vector_index.build(table.limit(0), str(tmp_path / "none"))
    assert vector_index.VectorIndex(spark, str(tmp_path / "none")).search(asked).count() == 0


def texts(seed, n):
    r = random.Random(seed)
    return [(i, " ".join([f"w{min(int(r.expovariate(0.2)), 40)}" for _ in range(r.choice((0, 1, 5, 30)))] + ([f"rare{i % 50}"] if i % 3 == 0 else []))) for i in range(n)]


def test_postings_in_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE", 16)
    path = str(tmp_path / "p")
    docs = spark.createDataFrame([*texts(3, 400), (900, None), (901, ""), (902, " \n\t w1  w1 w2 "), (903, "w3 " * 5_000)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, ["rare3"]), (2, ["w1", "w2", "w2", "rare6"]), (3, []), (4, ["nowhere"]), (5, ["w40", "rare0", "rare9"]), (6, ["w3"])], "query_id long, words array<string>")
    assert postings.Postings(spark, path).bm25(asked).count() == 0
    assert postings.append(docs.where("doc_id < 100"), path) == 0
    assert rows_of(postings.Postings(spark, path).bm25(asked, 5)) == rows_of(Corpus(docs.where("doc_id < 100"), asked).bm25(5))
    assert postings.append(docs.where("doc_id >= 100"), path) == 1 and postings.append(docs.limit(0), path) == 2
    index = postings.Postings(spark, path)
    assert rows_of(index.bm25(asked, 5)) == rows_of(Corpus(docs, asked).bm25(5))
    assert index.read[0]["pairs"] < index.read[0]["of_pairs"]
    monkeypatch.setattr(postings, "BLOCK_TERMS", 3)
    assert rows_of(index.bm25(asked, 5)) == rows_of(Corpus(docs, asked).bm25(5)) and len(index.read) > 1
    names = spark.createDataFrame([("a", ["w1"])], "query_id string, words array<string>")
    assert rows_of(index.bm25(names, 3)) == rows_of(Corpus(docs, names).bm25(3))


def state_table(spark, path, **more):
    return KeyedTable(spark, path, "id", inquiries.STATE, inquiries.STATE_MERGES, **more)


def events(spark, n=300):
    r = random.Random(8)
    kinds = ("created", "generated", "saved", "retopic", "failed", "retried", "sent", "unheard of")
    rows = [(r.randrange(20), i, r.choice(kinds), r.choice(("a", "b", None)), r.random(), f"d{i}", r.choice((f"f{i}", None)), r.random(), r.random() < 0.5, f"c{i}", r.random() < 0.5) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, seq long, kind string, topic string, confidence double, draft string, final string, edit_similarity double, quality_alert boolean, call_id string, operator_edited_topic boolean")
    return df.withColumn("at", F.expr("make_timestamp_ntz(2024, 1, 1, 0, 0, 0) + make_dt_interval(0, 0, seq % 97, 0)"))


def all_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def files(path):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path).rglob("*.parquet")}


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2, 1)])
def test_keyed_table_is_the_fold_in_any_order(spark, tmp_path, order):
    rows, table = events(spark), state_table(spark, str(tmp_path / "t"), buckets=4)
    for n, part in enumerate(order):
        table.upsert(inquiries.state_changes(rows.where(F.col("seq") % 4 == part)))
        if n == 1:
            assert table.compact() == [0, 1, 2, 3]
    want = all_of(inquiries.fold(rows))
    assert all_of(table.read()) == want
    assert all_of(table.read(keys=[3, 5, 99])) == all_of(inquiries.fold(rows.where("id IN (3, 5)")))
    table.compact()
    assert all_of(table.read()) == want and table.manifest()["deltas"] == {} and table.compact() == []


def test_compaction_leaves_other_buckets_alone(spark, tmp_path):
    rows, table = events(spark), state_table(spark, str(tmp_path / "t"), buckets=8)
    table.upsert(inquiries.state_changes(rows))
    table.compact()
    before, number = files(tmp_path / "t" / "base"), table.manifest()["number"]
    last = all_of(table.read())
    change = spark.createDataFrame([(7, 10_000, "sent")], "id long, n long, to string").select("id", stamped(F.col("to"), F.col("n")).alias("status"))
    table.upsert(change)
    touched = table.compact()
    after = files(tmp_path / "t" / "base")
    assert len(touched) == 1 and {p: after.get(p) for p in before} == before and len(after) == len(before) + 1
    assert {r.id: r.status for r in table.read().collect()}[7] == "sent" and all_of(table.read(number)) == last
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # nothing to merge, so nothing is shuffled


def test_keyed_table_at_the_edges(spark, tmp_path):
    table = state_table(spark, str(tmp_path / "t"))
    assert table.read().count() == 0 and table.compact() == [] and table.numbers() == []
    table.upsert(spark.createDataFrame([], "id long"))
    table.upsert(spark.createDataFrame([(None,)], "id long"))
    assert table.numbers() == []
    twice = spark.createDataFrame([(1, "x", 5), (1, "y", 5), (1, None, 4), (2, None, 9)], "id long, to string, n long").select("id", stamped(F.col("to"), F.col("n")).alias("topic"), F.lit("extra").alias("other"))
    table.upsert(twice)
    table.upsert(twice)
    assert {(r.id, r.topic, r.status) for r in table.read().collect()} == {(1, "y", None), (2, None, None)}


def test_of_two_writers_one_starts_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one, other = state_table(spark, path), state_table(spark, path)
    change = lambda k: spark.createDataFrame([(k,)], "id long")
    one.upsert(change(1))
    stale = other.manifest()
    one.upsert(change(2))
    real, seen = KeyedTable.manifest, []
    monkeypatch.setattr(KeyedTable, "manifest", lambda self, number=None: seen.append(1) or (stale if len(seen) == 1 else real(self, number)))
    other.upsert(change(3))
    monkeypatch.undo()
    assert sorted(r.id for r in one.read().collect()) == [1, 2, 3] and one.numbers() == [0, 1, 2]
    assert not write_once(spark, f"{path}/manifest/0000000001.json", "other") and not [f for f in os.listdir(f"{path}/manifest") if f.endswith(".tmp")]

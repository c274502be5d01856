"""What must not grow with the input: rows that one task reads, and memory of a task."""

import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa

from tamarisk.operators import embedding, retrieve, sorted_table, vector_index
from tamarisk.streaming import calls


def peak_mb(run):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_the_sample_of_an_index_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "TRAIN_ROWS", 400)
    rows = spark.range(3_000).selectExpr("id", "array(CAST(id % 7 AS DOUBLE), CAST(id % 11 AS DOUBLE)) AS v")
    sample = vector_index._sample(rows, 3_000)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert 100 < sample.count() <= 400 and "TakeOrdered" not in plan and "SinglePartition" not in plan
    for kinds in (1, 2):
        same = spark.range(3_000).selectExpr(f"id % {kinds} AS vec_id", f"array(1.0D, CAST(id % {kinds} AS DOUBLE)) AS embedding")
        vector_index.build(same, str(tmp_path / f"same{kinds}"))  # all or none of a kind are drawn
        assert int(vector_index.VectorIndex(spark, str(tmp_path / f"same{kinds}")).n.sum()) == 3_000


def test_sums_of_an_embedding_meet_in_groups(spark, monkeypatch):
    """The sum is that of all tasks, and the first exchange is by more than the block, so that no group has the rows of all."""
    docs, plans = spark.range(64).selectExpr("CAST(id AS STRING) AS text").repartition(64), []
    monkeypatch.setattr(embedding, "FEATURES", 512)
    real = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or real(self))
    total = embedding._summed(docs, lambda batches: np.full((512, 2), float(sum(b.num_rows for b in batches))))
    assert total.shape == (512, 2) and (total == 64).all()
    dealt = [line for line in plans[0].splitlines() if "hashpartitioning(block" in line]
    assert len(dealt) == 2 and "tasks" in dealt[-1]


def test_scores_are_bounded_in_pairs():
    """Documents that hold words of nearly all queries: 8 million pairs of a term and a query in all."""
    words = [f"w{i}" for i in range(40)]
    block = retrieve._Block([SimpleNamespace(query_id=q, term=w, qtf=1) for q in range(500) for w in words])
    block.idf[:] = 1.0
    texts = pa.array([" ".join(words)] * 400 + ["none", ""])
    parts, peak = peak_mb(lambda: [(len(x[-1][0]), bool((x[-1] == 40).all())) for x in block.scores(texts)])
    assert sum(n for n, _ in parts) == 402 and [all_terms for _, all_terms in parts][:-1] == [True] * (len(parts) - 1)
    assert len(parts) > 10 and peak < 120


def test_vectors_are_compared_in_tiles():
    rng = np.random.default_rng(4)
    rows, asked = rng.normal(size=(6_000, 8)), rng.normal(size=(1_500, 8))
    held = retrieve.Best(5, len(asked), pa.int64())
    _, peak = peak_mb(lambda: (held.scan(pa.array(np.arange(6_000)), rows, asked, np.arange(1_500)), held.merge()))
    want = np.lexsort((np.arange(6_000)[None].repeat(1_500, 0), -retrieve.rounded(asked @ rows.T)), axis=1)[:, :5]
    assert held.ids.to_numpy().reshape(1_500, 5).tolist() == want.tolist() and peak < 80


def test_many_sort_files_of_many_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sorted_table, "FILE_ROWS", 100)
    table = sorted_table.SortedTable(spark, str(tmp_path / "t"), "status", "at", "id")
    table.build(spark.range(2_000).selectExpr("id", "'a' AS status", "id AS at"), 2)
    assert [r.id for r in table.page("a", 3, (1_500, 1_500)).collect()] == [1_499, 1_498, 1_497] and table.of_files >= 15


def test_a_thread_has_one_value_and_one_timer():
    """Calls of the state store do not grow with the rows of a thread, and a call looks up its decision."""
    calls_made = []

    class Handle:
        def __getattr__(self, name):
            return lambda *a: calls_made.append(name) or self

        get = lambda self: calls_made.append("get")

    n = 40_000
    review = calls.ReviewProcessor(3_600_000)
    review.init(Handle())
    rows = pd.DataFrame({"seq": range(2 * n), "at": [1_000_000 * i for i in range(2 * n)], "kind": ["ask"] * n + ["approve"] * n})
    began = time.time()
    found = list(review.handleInputRows(("t",), iter([rows]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert time.time() - began < 20 and len(calls_made) <= 6
    assert len(found[0]) == n and set(found[0]["decided_by"].dropna()) == {n}


def test_tokens_of_many_texts_share_a_value():
    state = SimpleNamespace(exists=False, get=None, updates=0)

    def update(value):
        state.exists, state.get, state.updates = True, value, state.updates + 1

    state.update = update
    rows = pd.DataFrame({"key": [f"k{k}" for k in range(300) for _ in range(4)], "i": [3, 2, 0, 2] * 300, "token": ["d", "c", "a", "c"] * 300})
    one = list(calls._pieces((0,), iter([rows]), state))
    two = list(calls._pieces((0,), iter([pd.DataFrame({"key": ["k7", "k7", "k8"], "i": [1, 0, 4], "token": ["b", "a", "e"]})]), state))
    assert state.updates == 2 and len(one) == 1 and (one[0]["text"] == "a").all() and len(one[0]) == 300
    assert two[0].values.tolist() == [["k7", 1, 3, "bcd"]] and sum(state.get[2]) == 2 * 300 - 2 + 1

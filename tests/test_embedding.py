"""The randomised decomposition against a dense one, and texts that share a topic without a word."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tamarisk.operators import embedding


def corpus(n=300):
    r = random.Random(1)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(6)]
    return [(i, " ".join(r.choice(topics[i % 6]) for _ in range(8)) + r.choice(("", " The", " the"))) for i in range(n)] + [(900, None), (901, ""), (902, "the " * 5_000)]


def test_against_a_dense_decomposition(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = embedding.fit(docs, rank=6)
    texts = pa.array([t for _, t in rows], pa.string())
    row, feature, value = model.rows(texts)
    dense = np.zeros((len(rows), embedding.FEATURES))
    dense[row, feature] = value
    _, singular, right = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(model.singular, singular[:6], rtol=1e-3)
    assert np.allclose(np.linalg.svd(right[:6] @ model.vectors)[1], 1, atol=1e-2)  # the same space
    df = len({i for i, t in rows if t and "the" in t.lower().split()})
    assert np.isclose(model.weight[embedding.counted(pa.array(["the"]))[1][0]], np.log((1 + len(rows)) / (1 + df)))


def test_texts_of_a_topic_are_near(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("embedding", F.lit("old")).repartition(2)
    model = embedding.fit(docs, rank=6)
    assert np.array_equal(embedding.fit(docs.repartition(5), rank=6).vectors.round(6), model.vectors.round(6))
    got = {r.doc_id: np.array(r.embedding) for r in embedding.embedded(docs, model).collect()}
    assert len(got) == 303 and not got[900].any() and not got[901].any() and all(abs(np.linalg.norm(v) - 1) < 1e-9 for i, v in got.items() if i < 300)
    assert got[0] @ got[6] > 0.8 and abs(got[0] @ got[1]) < 0.3
    empty = embedding.fit(docs.limit(0))
    assert not empty.embed(pa.array(["x"])).any() or empty.vectors.shape == (embedding.FEATURES, embedding.RANK)

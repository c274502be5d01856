"""Text embeddings: hashed terms, weighted by rarity, reduced by a randomised singular value decomposition.

A text is a sparse row of FEATURES hashed terms, (1 + log tf) log((1 + n) / (1 + df)), at unit length. The leading right singular
vectors of all rows come from block power iteration: in each round every task multiplies its rows with the current block and
back, and adds up one FEATURES x (rank + OVERSAMPLING) matrix; these are summed in Spark by blocks of features, those of some
tasks first, and the driver makes the small sum orthogonal. So a round reads the corpus once and shuffles a matrix for each of
its tasks, and what is collected does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES, RANK, OVERSAMPLING, ROUNDS = 1 << 13, 48, 8, 5
#: Features of a sum that travel as one row, and groups of tasks whose sums are added up first.
BLOCK, GROUPS = 256, 32
#: Bytes of text that are worked on at a time.
SLICE = 4 << 20


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, int(batch.num_rows * min(1.0, SLICE / max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and number of each feature in a text; words are runs without white space, in lower case."""
    n = len(texts)
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.take(pa.array(range(n), pa.int64())).cast(pa.large_string()), "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    feature = np.fromiter((xxhash.xxh3_64_intdigest(w) % FEATURES if w else -1 for w in words), np.int64, len(words))[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    keys, tf = np.unique((row * FEATURES + feature)[feature >= 0], return_counts=True)
    return keys // FEATURES, keys % FEATURES, tf


@dataclass(frozen=True)
class Embedding:
    weight: np.ndarray
    vectors: np.ndarray
    singular: np.ndarray

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sparse rows: row, feature, value."""
        row, feature, tf = counted(texts)
        value = (1 + np.log(tf)) * self.weight[feature]
        norm = np.sqrt(np.bincount(row, value**2, len(texts)))
        return row, feature, value / np.maximum(norm[row], 1e-300)

    def embed(self, texts: pa.Array) -> np.ndarray:
        """Vectors of unit length; zeros for texts without words."""
        out = _times(*self.rows(texts), len(texts), self.vectors)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _times(row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """Sparse rows times a block, column by column."""
    return np.stack([np.bincount(row, value * block[feature, j], n) for j in range(block.shape[1])], axis=1) if len(row) else np.zeros((n, block.shape[1]))


def _summed(docs: DataFrame, own) -> np.ndarray:
    """The sum over all tasks of own(batches), a matrix of FEATURES rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = own(batches)
        blocks = [total[at : at + BLOCK].astype(np.float64).tobytes() for at in range(0, FEATURES, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "sums"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"block": t["block"][:1], "sums": pa.array([sum(np.frombuffer(x.as_buffer()) for x in t["sums"]).tobytes()], pa.binary())})

    kind = "block int, sums binary"
    some = docs.mapInArrow(run, kind).withColumn("tasks", F.spark_partition_id() % GROUPS).groupBy("block", "tasks").applyInArrow(add, kind)
    found = some.groupBy("block").applyInArrow(add, kind).orderBy("block").collect()  # FEATURES rows of numbers
    width = len(found[0].sums) // 8 // BLOCK if found else 1
    return np.concatenate([np.frombuffer(r.sums).reshape(-1, width) for r in found]) if found else np.zeros((FEATURES, 1))


def fit(docs: DataFrame, text_col: str = "text", rank: int = RANK) -> Embedding:
    """The embedding of a corpus, from all its texts. Null texts have no words."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        seen = np.zeros((FEATURES, 2))
        for batch in _slices(batches):
            _, feature, _ = counted(batch.column(0))
            seen[:, 0] += np.bincount(feature, minlength=FEATURES)
            seen[0, 1] += batch.num_rows
        return seen

    seen = _summed(texts, frequencies)
    n = seen[0, 1] if seen.shape[1] > 1 else 0
    weight = np.log((1 + n) / (1 + seen[:, 0]))
    # a fixed start, so that a corpus has one embedding however it is split
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(FEATURES, rank + OVERSAMPLING)))[0]
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(Embedding(weight, block, np.zeros(0)))

        def product(batches: Iterator[pa.RecordBatch], shared=shared) -> np.ndarray:
            now = shared.value
            total = np.zeros_like(now.vectors)
            for batch in _slices(batches):
                row, feature, value = now.rows(batch.column(0))
                left = _times(row, feature, value, batch.num_rows, now.vectors)
                for j in range(total.shape[1]):
                    total[:, j] += np.bincount(feature, value * left[row, j], FEATURES)
            return total

        raised = _summed(texts, product)
        if raised.shape != block.shape:
            break
        # within the span of the block, what the rows' own directions are
        values, turn = np.linalg.eigh(block.T @ raised)
        order = np.argsort(-values)
        best, singular = block @ turn[:, order[:rank]], np.sqrt(np.maximum(values[order[:rank]], 0))
        block = np.linalg.qr(raised)[0]
    else:
        return Embedding(weight, best * np.where(best[np.abs(best).argmax(0), np.arange(best.shape[1])] < 0, -1, 1), singular)
    return Embedding(weight, block[:, :rank], np.zeros(rank))


def embedded(docs: DataFrame, model: Embedding, text_col: str = "text") -> DataFrame:
    """docs with embedding: an array of doubles of unit length; zeros without known words. A column of that name gives way."""
    own = docs.drop("embedding")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = own.withColumn("_text", F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            vectors = shared.value.embed(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(vectors), pa.list_(pa.float64()))], [*batch.schema.names[:-1], "embedding"])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in own.schema)}, embedding array<double>")

"""Arrow batches in small pieces, so that what a worker builds from one stays small whatever the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time, unless a single text is longer.
SLICE = 8 << 20


def texts_of(column: pa.Array) -> pa.Array:
    """A text column as large strings from offset 0 (the split kernels misread others), nulls as empty."""
    return pc.fill_null(column.take(pa.array(range(len(column)), pa.int64())).cast(pa.large_string()), "")


def in_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in order, halved until a piece has at most so many bytes or is a single row."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows > 1 and batch.nbytes > most:
            half = batch.num_rows // 2
            yield from cut(batch.slice(0, half))
            yield from cut(batch.slice(half))
        elif batch.num_rows:
            yield batch

    for batch in batches:
        yield from cut(batch)


def sliced(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], most: int = SLICE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over batches in such pieces."""
    return lambda batches: run(in_slices(batches, most))

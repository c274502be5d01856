"""Tokens and chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

SIZE, OVERLAP = 1000, 100


def tokens(text: Column) -> Column:
    """Words between white space of any script; nulls have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def fixed_chunks(df: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each window of `size` code points, each `overlap` into its predecessor: chunk_no, chunk. Empty texts give one empty chunk."""
    step = size - overlap
    value = F.coalesce(F.col(text), F.lit(""))
    last = F.greatest(F.ceil((F.char_length(value) - overlap) / step), F.lit(1)) - 1
    return df.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("chunk", value.substr(F.col("chunk_no").cast("int") * step + 1, F.lit(size)))


def _split(text: str, marks: list[str], size: int) -> list[str]:
    """Pieces of at most size characters that end at the coarsest mark that allows it."""
    if len(text) <= size:
        return [text]
    for at, mark in enumerate(marks):
        if mark and mark in text:
            parts = text.split(mark)
            whole = [p + mark for p in parts[:-1]] + parts[-1:]
            return [x for p in whole if p for x in _split(p, marks[at + 1 :], size)]
    return [text[i : i + size] for i in range(0, len(text), size)]


def recursive_chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most size characters, cut at paragraphs, lines, words or anywhere, in this order of preference; a
    chunk begins with the last pieces of its predecessor, as far as they have no more than overlap characters."""
    out: list[str] = []
    held: deque[str] = deque()
    total = 0
    for piece in _split(text, ["\n\n", "\n", " "], size):
        if held and total + len(piece) > size:
            out.append("".join(held))
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.popleft())
        held.append(piece)
        total += len(piece)
    return [*out, "".join(held)] if held else out


def recursive_chunk_rows(df: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each recursive chunk: the other columns, chunk_no, chunk. Null and empty texts have one empty chunk. Texts go through by
    Arrow batches, and chunks leave a few thousand at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row: list[int] = []
            number: list[int] = []
            chunks: list[str] = []

            def full(batch=batch, row=row, number=number, chunks=chunks) -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(chunks, pa.string())], ["own", "chunk_no", "chunk"])
                row.clear(), number.clear(), chunks.clear()
                return out

            for i in range(batch.num_rows):
                for k, chunk in enumerate(recursive_chunks(batch.column(1)[i].as_py() or "", size, overlap)):
                    row.append(i)
                    number.append(k)
                    chunks.append(chunk)
                    if len(chunks) >= 4_096:
                        yield full()
            yield full()

    others = [c for c in df.columns if c not in (text, "chunk_no", "chunk")]
    own = df.select(F.struct(*others).alias("own") if others else F.lit(None).cast("boolean").alias("own"), F.col(text).cast("string").alias("text"))
    rows = own.mapInArrow(run, StructType([own.schema[0], StructField("chunk_no", IntegerType()), StructField("chunk", StringType())]))
    return rows.select(*[F.col("own")[c].alias(c) for c in others], "chunk_no", "chunk")

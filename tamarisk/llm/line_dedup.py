"""Line deduplication: first occurrences in hash order, returned as a keep bitmap per document.

Every scan task hashes the lines of its batches. Where a key recurs within a batch, only the lines of its least document
go on; the rest are known to be repeats there and then, so a line that a third of all documents share arrives as one row
per batch. Survivors are dealt by ranges of the hash and sorted by hash, document and position, and a stream over each
range keeps the lines of the first document of every key. Keys that a sample finds frequent leave before that: their first
document is a minimum that is combined on the map side, so no range gathers one key. Only positions of dropped lines return
to the documents, as bitmaps (one bit a line, zlib); line_bitmaps never shuffles text, and line_dedup only those texts that
lose lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tamarisk.llm.arrow import sliced
from tamarisk.llm.tables import held, let_go, passed_through, shuffle_partitions, stored

#: What is stripped from a line's ends, and the least number of code points of a key.
STRIPPED = b" \t\n\x0b\x0c\r"
LEAST_KEY = 10
#: Rows without an id count as one document that comes after all others.
NO_ID = (1 << 63) - 1
#: About so many rows are sampled for frequent keys: those with one row in FREQUENT, so there are FREQUENT of them at most.
SAMPLE, FREQUENT = 200_000, 1_000
#: So many hashes are broadcast to pick the texts that lose lines (8 bytes each); more are joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000

_EVENTS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("text_key", pa.int64()), ("lines", pa.binary()), ("n_lines", pa.int64())])


def line_keys(text: str) -> list[bytes | None]:
    """The 16-byte key of each line; None where the stripped line is too short to count."""
    out: list[bytes | None] = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(STRIPPED)
        long = len(key) >= 4 * LEAST_KEY or len(key) >= LEAST_KEY and sum((c & 0xC0) != 0x80 for c in key) >= LEAST_KEY
        out.append(xxhash.xxh3_128_digest(key.lower()) if long else None)
    return out


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a document (h1 null): its number of lines and those dropped at once. Of a key: the lines of its least document here."""
    for batch in batches:
        docs, texts, marks = (batch.column(i).to_pylist() for i in range(3))
        keys: list[bytes] = []
        at: list[int] = []
        row: list[int] = []
        counts = []
        for i, text in enumerate(texts):
            own = line_keys(text)
            counts.append(len(own))
            for p, k in enumerate(own):
                if k is not None:
                    keys.append(k)
                    at.append(p)
                    row.append(i)
        halves = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
        pos, rows = np.array(at, np.uint32), np.array(row, np.int64)
        ids = np.array(docs, np.int64)
        order = np.lexsort((pos, rows, ids[rows], halves[:, 1], halves[:, 0]))
        halves, pos, rows = halves[order], pos[order], rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (halves[1:] != halves[:-1]).any(1)
        first = ids[rows[np.flatnonzero(new)]][np.cumsum(new) - 1] if len(rows) else ids[:0]
        stays = ids[rows] == first
        lost: dict[int, list[int]] = {}
        for i, p in zip(rows[~stays].tolist(), pos[~stays].tolist(), strict=True):
            lost.setdefault(i, []).append(p)
        n = len(docs)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array([np.array(lost.get(i, []), np.uint32).tobytes() for i in range(n)], pa.binary()), pa.array(counts, pa.int64())], schema=_EVENTS)
        halves, pos, rows = halves[stays], pos[stays], rows[stays]
        if len(rows):
            # a row for each key and row of the table, with all positions there
            begins = np.ones(len(rows), bool)
            begins[1:] = (halves[1:] != halves[:-1]).any(1) | (rows[1:] != rows[:-1])
            start = np.flatnonzero(begins)
            bounds = np.append(start, len(rows))
            lines = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(pos.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(halves[start, 0]), pa.array(halves[start, 1]), pa.array(ids[rows[start]]), pa.array(np.array(marks, np.int64)[rows[start]]), lines, pa.nulls(len(start), pa.int64())], schema=_EVENTS)


def _later_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key and document: those whose document isn't the first of their key."""
    key, holder = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (batch.column(i).to_numpy() for i in range(3))
        new = np.ones(len(doc), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = key != (h1[0], h2[0])
        group = np.cumsum(new)
        first = np.concatenate([[0 if holder is None else holder], doc[new]])[group]
        key, holder = (h1[-1], h2[-1]), first[-1]
        yield batch.select(["doc", "text_key", "lines"]).filter(pa.array(doc != first))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dropped, maps = [], []
        for n, lost in zip(batch["n_lines"].to_pylist(), batch["lost"].to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[np.frombuffer(b"".join(lost), np.uint32)] = False
            dropped.append(int(n - keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([batch["doc"], batch["text_key"], batch["n_lines"], pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], ["doc", "text_key", "n_lines", "n_dropped", "keep"])


def kept_lines(text: str, keep: bytes) -> str:
    """The text that a bitmap leaves."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(line for line, bit in zip(lines, bits.tolist(), strict=True) if bit)


def _whole(id_col: str, text_col: str) -> list:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("text"), F.xxhash64(text, F.octet_length(text)).alias("text_key")]


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct (doc, text_key): n_lines, n_dropped, keep (zlib of one bit per line, first line first).

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least 10 code points that several
    documents hold lose all lines but those of the least id; within that document repeats stay. Null and empty texts are one
    empty line, which is too short to go. Long texts and lines are read whole. Rows that repeat an id are one document. Rows
    without an id are one document after all others (doc is 2 ** 63 - 1). An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    events = stored(docs.select(*_whole(id_col, text_col)).mapInArrow(sliced(_events), "h1 long, h2 long, doc long, text_key long, lines binary, n_lines long"), "lines")
    keys = events.where("h1 IS NOT NULL").select("h1", "h2", "doc", "text_key", "lines")
    later = []
    if frequent := _frequent(keys.select("h1", "h2"), events.count()):
        own = F.broadcast(spark.createDataFrame(frequent, "h1 long, h2 long"))
        firsts = stored(keys.join(own, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("doc").alias("first")), "firsts")
        later.append(keys.join(F.broadcast(firsts), ["h1", "h2"]).where("doc <> first").select("doc", "text_key", "lines"))
        keys = keys.join(own, ["h1", "h2"], "left_anti")
    later.append(keys.repartitionByRange(shuffle_partitions(spark), "h1", "h2").sortWithinPartitions("h1", "h2", "doc").mapInArrow(_later_documents, "doc long, text_key long, lines binary"))
    known = events.where("h1 IS NULL").select("doc", "text_key", "lines", "n_lines")
    all_lost = known.unionByName(reduce(DataFrame.unionByName, later).withColumn("n_lines", F.lit(None).cast("long")))
    # a set, as rows that repeat a document tell the same of it
    lost = all_lost.groupBy("doc", "text_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set(F.when(F.octet_length("lines") > 0, F.col("lines"))).alias("lost"))
    return lost.mapInArrow(sliced(_bitmaps), "doc long, text_key long, n_lines long, n_dropped long, keep binary")


def _frequent(keys: DataFrame, n: int) -> list[tuple[int, int]]:
    """Keys with at least one in FREQUENT of a sample. They only take another way; which ones they are changes no result."""
    counted = keys.sample(min(1.0, SAMPLE / max(n, 1)), seed=1).groupBy("h1", "h2").agg(F.count("*").alias("c"))
    return [(r.h1, r.h2) for r in counted.where(F.col("c") >= max(min(n, SAMPLE) // FREQUENT, 20)).collect()]


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text (last but one) that the bitmap (last) leaves, in the place of both."""
    for batch in batches:
        n = batch.num_columns
        pairs = zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist(), strict=True)
        cut = [t if k is None else kept_lines(t, k) for t, k in pairs]
        yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(cut, pa.string())], [*batch.schema.names[: n - 2], "_kept"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """A row for every input row: the named columns (all unless given), _n_lines, _n_dropped and _kept (the text that stays).

    See line_bitmaps. An input column with the name of a result gives way to it.
    """
    maps = stored(line_bitmaps(docs, id_col, text_col), "bitmaps")
    columns = passed_through(docs, docs.columns if columns is None else columns, ("_n_lines", "_n_dropped", "_kept"))
    doc, text, text_key = _whole(id_col, text_col)
    code = F.xxhash64("doc", "text_key").alias("code")
    own = docs.select(held(columns), text, doc, text_key).select("*", code)
    losing = maps.where("n_dropped > 0").select("doc", "text_key", "n_lines", "n_dropped", "keep")
    codes = losing.select(code)
    few = codes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    codes = F.broadcast(codes) if few else codes
    whole = own.join(codes, "code", "left_anti")
    # every row of the table is one line longer than it has line ends
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    whole = whole.select("own", n_lines.cast("long").alias("_n_lines"), F.lit(0).cast("long").alias("_n_dropped"), F.col("text").alias("_kept"))
    # a text that only has the code of another finds no bitmap, and stays as it is
    some = own.join(codes, "code", "left_semi").join(losing, ["doc", "text_key"], "left")
    some = some.select("own", F.coalesce("n_lines", n_lines).cast("long").alias("_n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("_n_dropped"), "text", "keep")
    cut = some.mapInArrow(sliced(_applied), StructType([*some.schema.fields[:3], StructField("_kept", StringType())]))
    return whole.unionByName(cut).select(*let_go(columns), "_n_lines", "_n_dropped", "_kept")

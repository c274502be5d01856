"""Token files: documents in order of their id, as entropy-coded blocks of token ids.

Format (Parquet as the container, so that Spark's committer makes each file whole or absent): a row is a segment of at
most SEGMENT ids, or of one document that is longer. `table` is the frequency table that all blocks of the segment
share, counted over every id in it; `blocks` are independent blocks (see rans) of whole documents, about BLOCK ids each.
doc_ids and n_tokens list the documents, block_docs how many each block holds. Segments of a shard are numbered; shards
follow each other in order of document ids, and start is the number of ids before the segment in its shard.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamarisk.llm.arrow import in_slices, texts_of
from tamarisk.llm.rans import Decoder, Encoder, Table
from tamarisk.llm.tables import drop_at_end, shared_dir, shuffle_partitions, stored

BLOCK, SEGMENT = 1 << 18, 1 << 22
#: Characters that go through the tokenizer at a time.
TOGETHER = 1 << 20
#: Parts of texts that share a call of the tokenizer.
LINES = 256
#: A space inside or at the end of a longer run of white space (every character that any Unicode version counts as such).
_WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ANY_WHITE = _WHITE
_RUN = rf"{_WHITE} {_WHITE}|{_WHITE} \z"


class TextEncoder:
    """Ids of whole texts, as the tokenizer gives them.

    Byte-level BPE codes a text piece by piece, and a space can only begin a piece, unless it is in a longer run of white
    space. So a text without such runs may be cut before every space; each distinct part then goes through the tokenizer
    once and is remembered. Other texts, those that hold an added token, and all texts for tokenizers of another kind go
    through it whole.
    """

    #: Parts that are remembered; beyond that all are forgotten, as they only save time.
    PARTS = 1_000_000

    def __init__(self, tokenizer_json: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        kind = repr(self.tokenizer.pre_tokenizer)
        self.by_part = kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind and self.tokenizer.normalizer is None
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = "|".join(map(re.escape, added))
        # an added token with white space in it could arise where parts are joined by lines
        self.line_end = line_end[0] if len(line_end) == 1 and not any(any(c.isspace() for c in t) for t in added) else None
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.begin, self.size = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; nulls are empty."""
        texts = texts_of(texts)
        odd = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False) if self.by_part else np.ones(len(texts), bool)
        if self.by_part and self.added:
            odd = odd | pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i, ids in zip(np.flatnonzero(odd).tolist(), self._whole(texts.filter(pa.array(odd)).to_pylist()), strict=True):
            out[i] = ids
        if not odd.all():
            for i, ids in zip(np.flatnonzero(~odd).tolist(), self._parts(texts.filter(pa.array(~odd))), strict=True):
                out[i] = ids
        return out

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has. A few texts at a time, as the library's results are large."""
        ids: list[np.ndarray] = [np.zeros(0, self.dtype)]
        sizes: list[int] = []
        reach = np.cumsum([len(t) for t in texts]) // TOGETHER
        bounds = [0, *(np.flatnonzero(np.diff(reach)) + 1).tolist(), len(texts)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]
            sizes += map(len, found)
            ids.append(np.fromiter(chain.from_iterable(found), self.dtype))
        return np.concatenate(ids), np.array(sizes, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        ids, sizes = self._coded(texts)
        return np.split(ids, np.cumsum(sizes)[:-1]) if texts else []

    def _parts(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        if len(self.known) > self.PARTS:
            self._forget()
        place = pc.index_in(coded.dictionary, value_set=self.known)
        fresh = pc.is_null(place)
        before = len(self.known)
        number = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        number[fresh.to_numpy(zero_copy_only=False)] = before + self._learn(coded.dictionary.filter(fresh))
        of_part = number[coded.indices.to_numpy()]
        # what stands before the first space has none of its own
        heads = self._whole([coded.dictionary[c].as_py() for c in coded.indices.to_numpy()[offsets[:-1]].tolist()])
        sizes, begins = self.size[of_part], self.begin[of_part]
        sizes[offsets[:-1]] = 0
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], ends])[offsets]
        return [np.concatenate([h, ids[a:b]]) for h, a, b in zip(heads, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _learn(self, parts: pa.Array) -> np.ndarray:
        """Remember new parts; gives the order in which they are numbered."""
        apart = pc.or_(pc.match_substring_regex(parts, _ANY_WHITE), pc.equal(parts, "")).to_numpy(zero_copy_only=False)
        if self.line_end is None:
            apart[:] = True
        # parts without white space go many at a time, one a line: a line end before a space is a piece of its own
        single = parts.filter(pa.array(~apart))
        bounds = np.append(np.arange(0, len(single), LINES), len(single))
        lines = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), single.cast(pa.string())) if len(single) else pa.array([], pa.list_(pa.string()))
        lined, _ = self._coded([f" {x}\n" for x in pc.binary_join(lines, "\n ").to_pylist()])
        stop = np.flatnonzero(lined == self.line_end) if len(single) else np.zeros(0, np.int64)
        begins = np.concatenate([np.zeros(1, np.int64), stop[:-1] + 1])[: len(stop)]
        rest = parts.filter(pa.array(apart))
        ids, sizes = self._coded([" " + p for p in rest.to_pylist()])
        self.known = pa.concat_arrays([self.known, single, rest])
        self.begin = np.concatenate([self.begin, len(self.flat) + begins, len(self.flat) + len(lined) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, stop - begins, sizes])
        self.flat = np.concatenate([self.flat, lined, ids])
        order = np.empty(len(parts), np.int64)
        order[np.concatenate([np.flatnonzero(~apart), np.flatnonzero(apart)])] = np.arange(len(parts))
        return order


@lru_cache(maxsize=2)
def text_encoder(tokenizer_json: str) -> TextEncoder:
    """One for each worker process, so that later tasks find the parts of earlier ones."""
    return TextEncoder(tokenizer_json)


def _segment(shard: int, number: int, start: int, docs: list[int | None], ids: list[np.ndarray]) -> dict:
    table = Table.of(np.bincount(np.concatenate(ids)))
    encoder = Encoder(table)
    blocks, members, held = [], [0], 0
    bounds = [0]
    for i, x in enumerate(ids):
        held += len(x)
        if held >= BLOCK or i == len(ids) - 1:
            bounds.append(i + 1)
            held = 0
    for a, b in zip(bounds, bounds[1:], strict=False):
        blocks.append(encoder.block(np.concatenate(ids[a:b])))
        members.append(b - a)
    return {"shard": shard, "segment": number, "start": start, "doc_ids": docs, "n_tokens": [len(x) for x in ids], "block_docs": members[1:], "table": table.dump(), "blocks": blocks}


_SEGMENTS = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("block_docs", pa.list_(pa.int64())), ("table", pa.binary()), ("blocks", pa.list_(pa.binary()))])
_SEGMENTS_DDL = "shard int, segment int, start long, doc_ids array<long>, n_tokens array<long>, block_docs array<long>, table binary, blocks array<binary>"


def _encoded(tokenizer_json, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_json.value)
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0
        end = np.array([end_id], encoder.dtype)

        def flush() -> pa.RecordBatch:
            nonlocal docs, ids, held, number, start
            out = pa.RecordBatch.from_pylist([_segment(shard, number, start, docs, ids)], schema=_SEGMENTS)
            docs, ids, number, start, held = [], [], number + 1, start + held, 0
            return out

        for batch in in_slices(batches):
            for doc, own in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                if held and held + len(own) + 1 > SEGMENT:
                    yield flush()
                docs.append(doc)
                ids.append(np.append(own, end))
                held += len(own) + 1
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write them to path in ascending order of ids; rows that repeat an id follow each other, by text.

    Null texts are empty: their only id is end_id. Texts are encoded whole, however long. Rows without an id come first. An
    empty table gives no segments. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "text")
    ranged.mapInArrow(_encoded(spark.sparkContext.broadcast(tokenizer_json), end_id), _SEGMENTS_DDL).write.option("compression", "none").parquet(path)


def _decoded(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, docs, sizes, members, table, blocks = (batch[c][row].as_py() for c in ("start", "doc_ids", "n_tokens", "block_docs", "table", "blocks"))
                decoder = Decoder(Table.load(table))
                sizes_at, first = np.array(sizes, np.int64), 0
                for block, count in zip(blocks, members, strict=True):
                    own, ids = sizes_at[first : first + count], decoder.block(block).astype("<u4")
                    cuts = np.cumsum(own)
                    parts = [x.tobytes() for x in np.split(ids, cuts[:-1])]
                    columns = [pa.array(docs[first : first + count], pa.int64()), pa.array(np.full(count, batch["shard"][row].as_py(), np.int32)), pa.array(start + cuts - own), pa.array(own)]
                    columns.append(pa.array([zlib.crc32(x) for x in parts], pa.int64()) if digest else pa.array(parts, pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, ["id", "shard", "within", "n_tokens", "ids_crc32" if digest else "ids"])
                    start, first = start + int(own.sum()), first + count

    return run


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """Decode the files at path: id, start (ids of all documents before), n_tokens, and ids (little-endian unsigned 32-bit
    integers) or, with digest, their unsigned CRC-32. A damaged block raises an error."""
    files = spark.read.schema(_SEGMENTS_DDL).parquet(path)
    # a row for each shard, of which there are as many as the writer had tasks
    totals = files.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n")).orderBy("shard").collect()
    offsets, before = [], 0
    for r in totals:
        offsets.append((r.shard, before))
        before += r.n
    kind = "ids_crc32 long" if digest else "ids binary"
    rows = files.mapInArrow(_decoded(digest), f"id long, shard int, within long, n_tokens long, {kind}")
    joined = rows.join(F.broadcast(spark.createDataFrame(offsets, "shard int, before long")), "shard")
    return joined.select(F.col("id").alias(id_col), (F.col("before") + F.col("within")).alias("start"), "n_tokens", kind.split()[0])


def token_digests(docs: DataFrame, tokenizer_json: str, end_id: int = 0) -> DataFrame:
    """Write the token files of documents to the shared folder, and read back what they hold of each document."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    drop_at_end(spark, path)
    write_tokens(docs, path, tokenizer_json, end_id)
    return stored(read_tokens(spark, path, digest=True), "token-digests")

"""Alignment of two tokenizers: where their tokens meet, which overlap, and which pairs go together most often.

Both tokenizers cut the same bytes. The ends of their tokens, cumulative over a text, are two ascending lists, which are
merged like by two pointers: every end of either side closes a stretch that lies in one token of A and in one of B, which
is a link of the two; an end that both have closes a group. Texts of an Arrow slice are merged at once, one behind the
other, as both sides end where a text ends.

Spark then adds up how often each pair of ids is linked in all texts, takes the maxima for each id of either side, and joins
both back to the texts. Only distinct pairs of a text are kept with it, so what is shuffled is a count for each pair and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.arrow import in_slices, texts_of
from tamarisk.llm.tables import stored
from tamarisk.llm.token_files import TOGETHER, TextEncoder

#: Bytes of text that are aligned at a time.
SLICE = 2 << 20
#: So many counted pairs are broadcast (about 60 bytes each), the most frequent ones; the others are joined by a shuffle.
BROADCAST_PAIRS = 400_000
ROWS_DDL = "id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
#: Fixed value: how piece models write a space.
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others for
    characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The bytes of each token: all behind each other, where they begin, and how many there are; -1 where a token has none."""

    def __init__(self, tokens: list[bytes | None]) -> None:
        self.size = np.array([-1 if t is None else len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)
        self.data = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        self.names = pa.array([str(i) for i in range(len(tokens))], pa.string())

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.begin[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class ByteEncoder(TextEncoder):
    """Ids of a byte-level tokenizer; strings of special tokens are plain text."""

    def __init__(self, tokenizer_json: str) -> None:
        super().__init__(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.added = ""
        alphabet = byte_alphabet()
        found: list[bytes | None] = [None] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if all(c in alphabet for c in token):
                found[i] = bytes(alphabet[c] for c in token)
        self.vocabulary = Vocabulary(found)


class PieceEncoder(TextEncoder):
    """Ids of a sentencepiece model for texts that begin with a space, which the model adds by itself.

    Where no piece holds a space behind another character, no merge reaches over a single space, so a text without runs of
    spaces may be cut before each; distinct parts go through the model once. Others go through it whole.
    """

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.dtype = np.uint16 if n <= 1 << 16 else np.uint32
        self.by_part = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.line_end = None
        self.vocabulary = Vocabulary([None if self.model.is_control(i) or self.model.is_unknown(i) else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)])
        self._forget()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts_of(texts)
        odd = pc.match_substring_regex(texts, rf"  | \z|{SPACE}").to_numpy(zero_copy_only=False) if self.by_part else np.ones(len(texts), bool)
        out: list = [None] * len(texts)
        for use, run in ((odd, lambda t: self._whole(t.to_pylist())), (~odd, self._parts)):
            if use.any():
                for i, ids in zip(np.flatnonzero(use).tolist(), run(texts.filter(pa.array(use))), strict=True):
                    out[i] = ids
        return out

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, at = [np.zeros(0, self.dtype)], [], 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (stop == at or held + len(texts[stop]) <= TOGETHER):
                held += len(texts[stop])
                stop += 1
            found = self.model.encode([t[1:] for t in texts[at:stop]], num_threads=1)
            sizes += map(len, found)
            ids.append(np.array([x for f in found for x in f], self.dtype))
            at = stop
        return np.concatenate(ids), np.array(sizes, np.int64)


@lru_cache(maxsize=2)
def encoders(tokenizer_json: str, model: bytes) -> tuple[ByteEncoder, PieceEncoder]:
    return ByteEncoder(tokenizer_json), PieceEncoder(model)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of these sizes."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _agree(ids: list[np.ndarray], vocabulary: Vocabulary, data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which texts the bytes of their tokens make up."""
    count = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids).astype(np.int64)
    known = _sums((vocabulary.size[flat] < 0).astype(np.int64), count) == 0
    good = known & (_sums(np.maximum(vocabulary.size[flat], 0), count) == size)
    own = vocabulary.bytes_of(flat[np.repeat(good, count)])
    same = own == data[np.repeat(good, size)]
    good[np.flatnonzero(good)[_sums((~same).astype(np.int64), size[good]) > 0]] = False
    return good


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def aligned(texts: pa.Array, a: ByteEncoder, b: PieceEncoder) -> dict[str, list]:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of each text; pairs are A's id * (number of B's ids) + B's."""
    n = len(texts)
    width = len(b.vocabulary.size)
    out: dict[str, list] = {c: [0] * n for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * n, "pairs": [np.zeros(0, np.int64)] * n, "times": [np.zeros(0, np.int32)] * n}
    texts = texts_of(texts)
    place = np.flatnonzero(pc.binary_length(texts).to_numpy() > 0)
    if not len(place):
        return out
    spaced = texts_of(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.take(pa.array(place)), pa.scalar("", pa.large_string())))
    offsets = np.frombuffer(spaced.buffers()[1], np.int64, len(spaced) + 1)
    data, size = np.frombuffer(spaced.buffers()[2], np.uint8)[: offsets[-1]], np.diff(offsets)
    sides = [x.encode(spaced) for x in (a, b)]
    good = np.logical_and(*(_agree(ids, x.vocabulary, data, size) for ids, x in zip(sides, (a, b), strict=True)))
    place, size = place[good], size[good]
    if not len(place):
        return out
    ids = [[x for x, use in zip(side, good.tolist(), strict=True) if use] for side in sides]
    count = [np.array([len(x) for x in side], np.int64) for side in ids]
    flat = [np.concatenate(side).astype(np.int64) for side in ids]
    ends = [np.cumsum(x.vocabulary.size[f]) for x, f in zip((a, b), flat, strict=True)]
    # the merge: every end of either side once, in order, and the token of each side that covers what comes before it
    merged = np.sort(np.concatenate(ends), kind="stable")
    merged = merged[np.append(merged[1:] != merged[:-1], True)]
    cover = [np.searchsorted(e, merged) for e in ends]
    common = (ends[0][cover[0]] == merged) & (ends[1][cover[1]] == merged)
    text_end = np.cumsum(size)
    links_end = np.searchsorted(merged, text_end) + 1
    groups_end = np.cumsum(common)[links_end - 1]
    n_links, n_groups = np.diff(links_end, prepend=0), np.diff(groups_end, prepend=0)
    # groups as text
    joined = [pc.binary_join(_lists(np.concatenate([[0], c[common] + 1]), x.vocabulary.names.take(pa.array(f))), ",") for c, x, f in zip(cover, (a, b), flat, strict=True)]
    written = pc.binary_join(_lists(np.concatenate([[0], groups_end]), pc.binary_join_element_wise(*joined, "|")), ";")
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in written.to_pylist()]
    # distinct pairs of each text
    text = np.repeat(np.arange(len(place)), n_links)
    span = len(a.vocabulary.size) * width
    keys, times = np.unique(text * span + flat[0][cover[0]] * width + flat[1][cover[1]], return_counts=True)
    cuts = np.searchsorted(keys, np.arange(1, len(place)) * span)
    pairs, times = np.split(keys % span, cuts), np.split(times.astype(np.int32), cuts)
    for k, i in enumerate(place.tolist()):
        for name, value in zip(out, (int(count[0][k]), int(count[1][k]), int(n_groups[k]), int(n_links[k]), digests[k], pairs[k], times[k]), strict=True):
            out[name][i] = value
    return out


def _rows(tokenizer_json, model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = encoders(tokenizer_json.value, model.value)
        whole = (pa.RecordBatch.from_arrays([pa.array(f["id"], pa.int64(), from_pandas=True), pa.array(f["row"], pa.int64()), pa.array(f["text"], pa.large_string(), from_pandas=True)], ["id", "row", "text"]) for f in frames)
        for batch in in_slices(whole, SLICE):
            yield pd.DataFrame({"id": batch.column(0).to_pandas(integer_object_nulls=True), "row": batch.column(1).to_pandas(), **aligned(batch.column(2), a, b)})

    return run


def alignments(docs: DataFrame, tokenizer_json: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, row (a number of its own), n_a, n_b, n_groups, n_links, groups_sha256, pairs, times."""
    sc = docs.sparkSession.sparkContext
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return own.mapInPandas(_rows(sc.broadcast(tokenizer_json), sc.broadcast(model)), ROWS_DDL)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, count, best_a, best_b: how many links of all texts hold the pair, and whether no other pair of its A id, or of its
    B id, has more."""
    entries = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("e"))
    counts = stored(entries.groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.times").alias("count")), "pairs")
    sides = {"a": F.floor(F.col("pair") / width), "b": F.col("pair") % width}
    for side, own in sides.items():
        most = counts.groupBy(own.alias(side)).agg(F.max("count").alias(f"most_{side}"))
        sides[side] = most
    both = counts.withColumn("a", F.floor(F.col("pair") / width)).withColumn("b", F.col("pair") % width).join(sides["a"], "a").join(sides["b"], "b")
    return both.select("pair", "count", (F.col("count") == F.col("most_a")).alias("best_a"), (F.col("count") == F.col("most_b")).alias("best_b"))


def _with_counts(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """entries (pair, ...) with the columns of counts. Frequent pairs, which many entries have, are always met by a broadcast."""
    n = counts.count()
    if n <= BROADCAST_PAIRS:
        return entries.join(F.broadcast(counts), "pair")
    least = counts.select(F.percentile_approx("count", 1 - BROADCAST_PAIRS / n, 100_000)).first()[0]
    often = F.col("count") > least
    first = entries.join(F.broadcast(counts.where(often)), "pair", "left")
    rest = first.where("count IS NULL").drop("count", "best_a", "best_b").join(counts.where(~often), "pair")
    return first.where("count IS NOT NULL").unionByName(rest)


def token_alignment(docs: DataFrame, tokenizer_json: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: id, n_a, n_b, n_groups, n_links, n_best, n_best_a, count_sum, groups_sha256.

    n_best (n_best_a) are the links whose pair is the most frequent one of its B id (A id) in all texts, ties included;
    count_sum adds up the counts of all links. Null and empty texts, and texts that either tokenizer does not give back byte
    for byte, have no tokens: zeros and an empty string. Long texts are read whole; rows that repeat an id are counted each;
    rows without an id are treated like others; an empty table gives no rows; other columns are ignored.
    """
    width = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    rows = stored(alignments(docs, tokenizer_json, model, id_col, text_col), "alignments")
    counts = stored(pair_counts(rows, width), "pair-counts")
    entries = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").cast("long").alias("times"))
    links = lambda c: F.sum(F.when(F.col(c), F.col("times")).otherwise(0))
    sums = _with_counts(entries, counts).groupBy("row").agg(links("best_b").alias("n_best"), links("best_a").alias("n_best_a"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.drop("pairs", "times").join(sums, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("n_best_a"), none("count_sum"), "groups_sha256")

"""Chat formatting: turns become bytes of one buffer by computed scatter indices.

The template is `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Control strings inside texts and roles, of this and of
other common templates, get a backslash after their first character, one more for each that is there already, so
unescaping takes one away. A line end closes a role, so in roles backslashes and line ends become a backslash and a letter
as well.

A batch is assembled without a loop over its turns: segment lengths, their cumulative offsets, and for the header, role,
text and closing segments index arrays that scatter whole Arrow buffers into one preallocated buffer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.tables import shuffle_partitions, stored

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Fixed value: control strings of chat templates, after their first character and any backslashes.
CONTROL = r"(<|\[)(\\*)(\|[A-Za-z_]+\|>|/?s>|/?INST\]|/?SYS>>|</?SYS>>)"
UNESCAPE = r"(<|\[)\\(\\*)(\|[A-Za-z_]+\|>|/?s>|/?INST\]|/?SYS>>|</?SYS>>)"
#: Only texts of these roles count for the loss.
LEARNED = ("assistant",)
PARTS_DDL = "conv_id long, first_turn long, part long, formatted string, n_chars long, turn_chars array<long>, mask array<struct<start:long,stop:long>>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, CONTROL, r"\1\\\2\3")


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, UNESCAPE, r"\1\2\3")


def escape_role(roles: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(escape(roles), "\\", "\\b"), "\n", "\\n")


def unescape_role(roles: pa.Array) -> pa.Array:
    """Every backslash of an escaped role begins an escape, so the two kinds can be undone one after the other."""
    return unescape(pc.replace_substring(pc.replace_substring(roles, "\\n", "\n"), "\\b", "\\"))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large string column."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


def assemble(columns: list[pa.Array | bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """n rows, each the concatenation of its columns (constant bytes or large strings): row offsets and the buffer."""
    sizes = [np.full(n, len(c)) if isinstance(c, bytes) else np.diff(_bytes(c)[0]) for c in columns]
    rows = np.concatenate([[0], np.cumsum(np.sum(sizes, axis=0))]).astype(np.int64)
    out = np.empty(rows[-1], np.uint8)
    at = rows[:-1].copy()
    for c, size in zip(columns, sizes, strict=True):
        if isinstance(c, bytes):
            out[(at[:, None] + np.arange(len(c))).ravel()] = np.tile(np.frombuffer(c, np.uint8), n)
        else:
            offsets, data = _bytes(c)
            own = data[offsets[0] : offsets[-1]]
            out[np.repeat(at - (offsets[:-1] - offsets[0]), size) + np.arange(len(own))] = own
        at += size
    return rows, out


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order, a row for each run of a conversation's turns in a batch."""
    part = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0)
        role, text = (pc.fill_null(batch.column(i).cast(pa.large_string()), "") for i in (2, 3))
        safe_role, safe_text = escape_role(role), escape(text)
        rows, data = assemble([START.encode(), safe_role, MIDDLE.encode(), safe_text, END.encode()], n)
        head = pc.utf8_length(safe_role).to_numpy() + len(START) + len(MIDDLE)
        body = pc.utf8_length(safe_text).to_numpy()
        chars = head + body + len(END)
        ids = pc.fill_null(conv, 0).to_numpy()
        null = pc.is_null(conv).to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
        begin = np.append(np.flatnonzero(new), n)
        texts = pa.Array.from_buffers(pa.large_string(), len(begin) - 1, [None, pa.py_buffer(rows[begin].astype(np.int64).tobytes()), pa.py_buffer(data)])
        learned = pc.is_in(role, pa.array(LEARNED, pa.large_string())).to_numpy(zero_copy_only=False)
        masks, turns = [], []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            start = np.cumsum(chars[a:b]) - chars[a:b] + head[a:b]
            masks.append([{"start": s, "stop": s + k} for s, k, use in zip(start.tolist(), body[a:b].tolist(), learned[a:b].tolist(), strict=True) if use])
            turns.append(chars[a:b].tolist())
        first = pa.array(begin[:-1])
        yield pa.RecordBatch.from_arrays(
            [conv.take(first), batch.column(1).take(first), pa.array(np.arange(part, part + len(first))), texts.cast(pa.string()), pa.array(np.add.reduceat(chars, begin[:-1])), pa.array(turns, pa.list_(pa.int64())), pa.array(masks, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
            ["conv_id", "first_turn", "part", "formatted", "n_chars", "turn_chars", "mask"],
        )
        part += len(first)


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted conversations in parts: conv_id, first_turn, shard, part, formatted, n_chars, turn_chars, mask.

    The parts of a conversation, by shard and part, are its formatted text one after another: a conversation of any
    length passes through in batches and over several shards (turns of the same number in one). turn_chars are the code points of each turn; mask lists, in
    code points from the part's start, the texts that count for the loss. Turns are in order of turn; ties by role, then
    text; turns without a number come first, rows that repeat stay. Null roles and texts are empty; long texts stay whole. Rows without a conversation are one
    conversation of their own. An empty table gives no parts; other columns are ignored, whatever their names.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    # bounds of ranges come from a sample that the driver collects, so no texts are among the keys
    ranged = rows.repartitionByRange(shuffle_partitions(turns.sparkSession), *order[:2]).sortWithinPartitions(*order)
    return ranged.mapInArrow(_format, PARTS_DDL).withColumn("shard", F.spark_partition_id())


def read_turns(formatted: str, turn_chars: list[int]) -> tuple[list[str], list[str]]:
    """Roles and texts of a formatted part."""
    roles, texts, at = [], [], 0
    for n in turn_chars:
        head, _, rest = formatted[at : at + n].partition(MIDDLE)
        roles.append(head[len(START) :])
        texts.append(rest[: len(rest) - len(END)])
        at += n
    return unescape_role(pa.array(roles, pa.large_string())).to_pylist(), unescape(pa.array(texts, pa.large_string())).to_pylist()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of parts in order: what each conversation's formatted text says, read back."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now: object = _digests
    n = loss = chars = 0
    whole, learned = hashlib.sha256(), hashlib.sha256()
    done: list[dict] = []

    def close() -> None:
        if now is not _digests:
            done.append({"conv_id": now, "n_turns": n, "turns_sha256": whole.hexdigest(), "loss_chars": loss, "loss_sha256": learned.hexdigest(), "formatted_chars": chars})

    for batch in batches:
        for conv, formatted, turn_chars, mask in zip(*(batch[c] for c in ("conv_id", "formatted", "turn_chars", "mask")), strict=True):
            if conv.as_py() != now:
                close()
                now, n, loss, chars, whole, learned = conv.as_py(), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            text = formatted.as_py()
            roles, texts = read_turns(text, turn_chars.as_py())
            for role, own in zip(roles, texts, strict=True):
                whole.update(f"{role}\n{own}\n".encode())
            for own in unescape(pa.array([text[m["start"] : m["stop"]] for m in mask.as_py()], pa.large_string())).to_pylist():
                loss += len(own)
                learned.update(own.encode())
            n, chars = n + len(roles), chars + len(text)
        if len(done) > 1000:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    close()
    yield pa.RecordBatch.from_pylist(done, schema=schema)


def read_back(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, from its parts.

    A digest runs through a conversation from its first to its last turn, so its parts meet in one task, which streams them.
    """
    held = stored(parts, "chat")
    ordered = held.repartition(shuffle_partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "shard", "part")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def escaped_sql(c: Column) -> Column:
    """The escaping of texts as a column expression."""
    return F.regexp_replace(c, CONTROL, r"$1\\$2$3")

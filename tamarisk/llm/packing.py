"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. A task packs its documents in windows: pieces go from long to short; each goes to
the open bin that it fills best; where none has room, a bin is opened of the size that costs least for each token it is
expected to hold. All sizes are weighed against what is really left in the window: a bin is expected to be filled by pieces
to come that fit beside the first one, as far as those are not needed for the room of bins already open. A sequence costs
its length, a fixed OVERHEAD, and a part that grows with the square of its length, as attention does. At the end every bin
is downsized to the least permitted length that holds its contents. Nothing is shuffled; a window closes at WINDOW
documents or WINDOW_TOKENS tokens, so what a task holds is bounded.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.arrow import in_slices
from tamarisk.llm.tables import held, let_go, passed_through, whole_text

CAPACITIES = (1_024, 2_048, 4_096, 8_192, 16_384)
#: What a sequence costs besides its length, in tokens; and the length at which the square part is as large as the length.
OVERHEAD, SQUARE = 64, 65_536
WINDOW, WINDOW_TOKENS = 16_384, 32 << 20
#: The token id after each document: a byte that UTF-8 never uses.
END = b"\xff"
RESULTS = ("piece", "start", "length", "bin_id", "bin_offset", "bin_capacity")
_DDL = "piece int, start long, length long, bin_id string, bin_offset long, bin_capacity long"


def cost(capacity: int, overhead: int = OVERHEAD, square: int = SQUARE) -> float:
    """What a sequence of this length costs."""
    return overhead + capacity + capacity * capacity / square


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, square: int = SQUARE) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) of each piece; no length may exceed the greatest capacity."""
    sizes = sorted(capacities)
    if lengths and max(lengths) > sizes[-1]:
        raise ValueError("a piece is longer than every capacity")
    price = {c: cost(c, overhead, square) for c in sizes}
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    falling = [-lengths[i] for i in order]
    left = np.concatenate([np.cumsum([lengths[i] for i in order][::-1], dtype=np.int64)[::-1], [0]]).tolist()
    room: list[tuple[int, int]] = []
    free_room = 0
    used: list[int] = []
    place: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for at, i in enumerate(order):
        need = lengths[i]
        best = bisect_left(room, (need, -1))
        if best < len(room):
            free, own = room.pop(best)
            free_room -= free
        else:

            def per_token(c: int, at: int = at, need: int = need) -> float:
                # tokens still to come in pieces short enough to stand beside this one
                beside = left[max(at + 1, bisect_left(falling, need - c))]
                return price[c] / max(1, need + min(c - need, max(0, beside - free_room)))

            free, own = min((c for c in sizes if c >= need), key=lambda c: (per_token(c), c)), len(used)
            used.append(0)
        place[i] = (own, used[own])
        used[own] += need
        free_room += free - need
        insort(room, (free - need, own))
    final = [next(c for c in sizes if c >= u) for u in used]
    return [(own, offset, final[own]) for own, offset in place]


def _packed(capacities: tuple[int, ...], overhead: int, square: int, content: bool):
    longest = max(capacities)

    def tokens_of(text: pa.Buffer, start: int, length: int) -> bytes:
        own = text.slice(start, min(length, text.size - start)).to_pybytes() if start < text.size else b""
        return own + END * (start + length == text.size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, window = TaskContext.get().partitionId(), 0
        waiting: list[pa.RecordBatch] = []
        held = tokens = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held, tokens, window
            docs = pa.Table.from_batches(waiting)
            n_own = docs.num_columns - 1 - content
            row, piece, start, length = [], [], [], []
            for i, n in enumerate(docs.column(n_own).to_pylist()):
                for k, at in enumerate(range(0, max(n, 1), longest)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(min(longest, n - at))
            bins = pack(length, capacities, overhead, square)
            # bin by bin, so that a sequence stands together
            order = sorted(range(len(bins)), key=lambda i: bins[i][:2])
            prefix, names = f"{task}-{window}-", [*docs.schema.names[:n_own], *RESULTS, *["tokens"] * content]
            text = docs.column(n_own + 1) if content else None
            for at in range(0, len(order), 1000):
                some = order[at : at + 1000]
                of = pa.array([row[i] for i in some], pa.int64())
                columns = [docs.column(c).take(of).combine_chunks() for c in range(n_own)]
                columns += [pa.array([piece[i] for i in some], pa.int32()), *(pa.array([x[i] for i in some], pa.int64()) for x in (start, length)), pa.array([f"{prefix}{bins[i][0]}" for i in some]), *(pa.array([bins[i][k] for i in some], pa.int64()) for k in (1, 2))]
                if content:
                    columns.append(pa.array([tokens_of(text[row[i]].as_buffer(), start[i], length[i]) for i in some], pa.binary()))
                yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names)
            window, waiting, held, tokens = window + 1, [], 0, 0

        for batch in in_slices(batches):
            at = 0
            while at < batch.num_rows:
                # to the end of the window or of the batch
                room = np.cumsum(batch.column(batch.num_columns - 1 - content).to_numpy()[at:]) <= WINDOW_TOKENS - tokens
                take = max(min(int(room.sum()), WINDOW - held), 0 if held else 1)
                if take:
                    part = batch.slice(at, take)
                    waiting.append(part)
                    held, tokens, at = held + take, tokens + (pc.sum(part.column(part.num_columns - 1 - content)).as_py() or 0), at + take
                if at < batch.num_rows or held >= WINDOW:
                    yield from close()
        if held:
            yield from close()

    return run


def best_fit(
    docs: DataFrame, length: str | None = None, columns: tuple[str, ...] = ("doc_id",), capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, square: int = SQUARE, text_col: str = "text", content: bool = False
) -> DataFrame:
    """A row for each piece of every document: the named columns, piece, start, length, bin_id, bin_offset, bin_capacity.

    length is a SQL expression for a document's tokens: by default those of a byte-level model, its UTF-8 bytes and an end
    mark, so a null or empty text has one token. With content there is a column tokens as well, the byte tokens of the piece
    (0xFF is the end mark): the pieces of a bin by bin_offset are its sequence, those of a document by piece its text. A
    document longer than the greatest capacity becomes pieces of that length and a rest; the others are one piece. A
    character may go over two pieces, as a byte is a token. A length of zero or less is an empty piece. bin_id is unique in
    the result; ties go by the order of rows. Rows that repeat, and rows without an id, are packed like any other. An empty
    table gives no rows. An input column with the name of a result gives way to it.
    """
    if content and length is not None:
        raise ValueError("content has the default length")
    results = (*RESULTS, *["tokens"] * content)
    tokens = F.octet_length(whole_text(text_col)) + 1 if length is None else F.expr(length)
    columns = passed_through(docs, columns, results)
    own = docs.select(held(columns), F.greatest(tokens.cast("long"), F.lit(0)).alias("n"), *[F.encode(whole_text(text_col), "UTF-8").alias("text")] * content)
    placed = own.mapInArrow(_packed(tuple(capacities), overhead, square, content), f"own {own.schema['own'].dataType.simpleString()}, {_DDL}" + ", tokens binary" * content)
    return placed.select(*let_go(columns), *results)

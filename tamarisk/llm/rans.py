"""Static range asymmetric numeral coding of token ids in numpy: interleaved lanes, checkpoints and checksums.

A table gives every symbol in use a share of 2 ** PRECISION. A block of n symbols is coded by `lanes` independent states
that take turns: symbol i belongs to lane i mod lanes, and all lanes move in one numpy step. Every `every` steps the
states and the place in the stream are written as a checkpoint, where decoding can start. Blocks know nothing of each other.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

PRECISION = 20
LOW = np.uint64(1 << 32)
EVERY = 128
MAGIC = b"tRAN"


@dataclass(frozen=True)
class Table:
    """Symbols in use (ascending), their shares and cumulative starts."""

    symbols: np.ndarray
    share: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Table:
        """From a count for each symbol; every symbol that occurs keeps a share of one at least."""
        symbols = np.flatnonzero(counts)
        if len(symbols) > 1 << PRECISION:
            raise ValueError("more symbols than shares")
        n = counts[symbols].astype(np.float64)
        share = 1 + np.floor(n * (((1 << PRECISION) - len(symbols)) / max(n.sum(), 1))).astype(np.int64)
        if len(symbols):
            share[np.argmax(share)] += (1 << PRECISION) - share.sum()
        return Table(symbols.astype(np.uint32), share.astype(np.uint64), np.concatenate([[0], np.cumsum(share)[:-1]]).astype(np.uint64))

    def dump(self) -> bytes:
        return zlib.compress(np.uint32(len(self.symbols)).tobytes() + np.diff(self.symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + self.share.astype("<u4").tobytes(), 6)

    @staticmethod
    def load(data: bytes) -> Table:
        raw = np.frombuffer(zlib.decompress(data), "<u4")
        n = int(raw[0])
        share = raw[1 + n : 1 + 2 * n].astype(np.int64)
        return Table(np.cumsum(raw[1 : 1 + n], dtype=np.uint32), share.astype(np.uint64), np.concatenate([[0], np.cumsum(share)[:-1]]).astype(np.uint64))


class Encoder:
    def __init__(self, table: Table) -> None:
        size = int(table.symbols[-1]) + 1 if len(table.symbols) else 0
        self.share, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.share[table.symbols], self.start[table.symbols] = table.share, table.start

    def block(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = int(np.clip(n // 64, 1, 1024))
        steps = -(-n // lanes)
        share, start = self.share[ids], self.start[ids]
        limit = share << np.uint64(64 - PRECISION)
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        written = 0
        for step in range(steps - 1, -1, -1):
            a, b = step * lanes, min(n, (step + 1) * lanes)
            x = state[: b - a]
            # a share of all 2 ** PRECISION has the limit 2 ** 64, which reads as 0: such a state never grows
            out = (x >= limit[a:b]) & (limit[a:b] > 0)
            if out.any():
                words.append((x[out] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                written += len(words[-1])
                x = np.where(out, x >> np.uint64(32), x)
            q = x // share[a:b]
            state[: b - a] = (q << np.uint64(PRECISION)) + (x - q * share[a:b]) + start[a:b]
            if step % EVERY == 0:
                marks.append((written, state.copy()))
        marks.reverse()
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        body = np.array([written - w for w, _ in marks], "<u4").tobytes() + b"".join(s.astype("<u8").tobytes() for _, s in marks) + stream.tobytes()
        head = np.array([n, lanes, EVERY, len(marks), len(stream), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())], "<u4")
        return MAGIC + head.tobytes() + body


class Decoder:
    def __init__(self, table: Table) -> None:
        self.table = table
        self.index = np.repeat(np.arange(len(table.symbols)), table.share.astype(np.int64)).astype(np.uint32)

    def block(self, data: bytes, first_mark: int = 0) -> np.ndarray:
        """The symbols of a block, from a checkpoint on. Raises ValueError where a checksum is wrong."""
        if data[:4] != MAGIC:
            raise ValueError("not a block")
        n, lanes, every, n_marks, n_words, body_crc, ids_crc = (int(x) for x in np.frombuffer(data, "<u4", 7, 4))
        body = memoryview(data)[32:]
        if zlib.crc32(body) != body_crc:
            raise ValueError("damaged block")
        places = np.frombuffer(body, "<u4", n_marks)
        out = np.zeros(n, np.uint32)
        if not n:
            return out
        state = np.frombuffer(body, "<u8", lanes, 4 * n_marks + 8 * lanes * first_mark).astype(np.uint64)
        words = np.frombuffer(body, "<u4", n_words, 4 * n_marks + 8 * lanes * n_marks)
        at, mask = int(places[first_mark]), np.uint64((1 << PRECISION) - 1)
        t = self.table
        begin = first_mark * every
        for step in range(begin, -(-n // lanes)):
            a, b = step * lanes, min(n, (step + 1) * lanes)
            x = state[: b - a]
            slot = x & mask
            k = self.index[slot]
            out[a:b] = k
            x = t.share[k] * (x >> np.uint64(PRECISION)) + slot - t.start[k]
            more = np.flatnonzero(x < LOW)
            if len(more):
                x[more] = (x[more] << np.uint64(32)) | words[at : at + len(more)].astype(np.uint64)
                at += len(more)
            state[: b - a] = x
        ids = t.symbols[out[begin * lanes :]]
        if not first_mark and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
            raise ValueError("damaged symbols")
        return ids

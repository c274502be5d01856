"""Streams of calls: reviews that wait, expire or are rejected together; tokens put in order; feedback joined to its call."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A row of a call whenever its state changes: waiting, approved, rejected or expired, and the event that decided it.
CALLS = "thread_id string, call_id long, state string, decided_by long"
#: Contiguous tokens: the number of the first, how many, and their text.
PIECES = "key string, first long, n long, text string"
#: Values of the state that texts are dealt over unless said.
BUCKETS = 1024


class ReviewProcessor(StatefulProcessor):
    """The open calls of a thread, and decisions that came before the calls they decide.

    A decision (approve or reject) is on every call of its thread that was asked before it, is undecided and not older than
    `wait`. State and result do not depend on the order of rows: the earliest decision by (at, seq) counts, also if it comes
    later. A thread has one timer, at the end of the first wait that is left: calls that are over then expire, or are forgotten
    if they were decided. What lies before the watermark can decide no further call and is forgotten. A thread's state is one
    value, read and written once for its rows of a batch.
    """

    def __init__(self, wait_ms: int) -> None:
        self.wait = wait_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        calls = "call array<bigint>, at array<bigint>, state array<string>, decided_at array<bigint>, decided_by array<bigint>"
        self.held = handle.getValueState("held", f"{calls}, seq array<bigint>, made array<bigint>, made_to array<string>, timer bigint")

    def _read(self) -> tuple[dict[int, tuple], dict[int, tuple], int | None]:
        """Calls, decisions, and when the timer fires."""
        held = self.held.get()
        if held is None:
            return {}, {}, None
        call, at, state, decided_at, decided_by, seq, made, to, timer = held
        return dict(zip(call, zip(at, state, decided_at, decided_by, strict=True), strict=True)), dict(zip(seq, zip(made, to, strict=True), strict=True)), timer

    def _write(self, calls: dict[int, tuple], decisions: dict[int, tuple], timer: int | None, fired: bool = False) -> None:
        """Keep them, with a timer for the first wait that ends."""
        wanted = min((self._deadline(v[0]) for v in calls.values()), default=None)
        if wanted != timer or fired:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if not calls and not decisions:
            self.held.clear()
            return
        columns = [list(c) for c in zip(*calls.values(), strict=True)] or [[], [], [], []]
        made = [list(c) for c in zip(*decisions.values(), strict=True)] or [[], []]
        self.held.update((list(calls), *columns, list(decisions), *made, wanted))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        calls, decisions, timer = self._read()
        changed: dict[int, tuple] = {}
        for batch in rows:
            for seq, at, kind in zip(batch["seq"].tolist(), batch["at"].tolist(), batch["kind"], strict=True):
                if kind == "ask" and seq not in calls:
                    calls[seq] = changed[seq] = (at, "waiting", None, None)
                elif kind != "ask":
                    decisions[seq] = (at, "approved" if kind == "approve" else "rejected")
        ordered = sorted((at, seq, state) for seq, (at, state) in decisions.items())
        places = [d[:2] for d in ordered]
        for call, (at, _, decided_at, decided_by) in list(calls.items()):
            nth = bisect_right(places, (at, call))
            first = ordered[nth] if nth < len(ordered) else None
            if first and first[0] <= at + self.wait and (decided_at is None or first[:2] < (decided_at, decided_by)):
                calls[call] = changed[call] = (at, first[2], first[0], first[1])
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self._write(calls, {seq: d for seq, d in decisions.items() if d[0] >= passed}, timer)
        if changed:
            yield self._rows(key[0], [(call, v[1], v[3]) for call, v in changed.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        calls, decisions, timer = self._read()
        over = {call: v for call, v in calls.items() if self._deadline(v[0]) <= now}
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        left = {call: v for call, v in calls.items() if call not in over}
        self._write(left, {seq: d for seq, d in decisions.items() if d[0] >= passed}, timer, fired=True)
        expired = [(call, "expired", None) for call, v in over.items() if v[1] == "waiting"]
        if expired:
            yield self._rows(key[0], expired)

    def _deadline(self, at: int) -> int:
        return -(-(at + self.wait) // 1000)

    def _rows(self, thread: str, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"thread_id": pd.Series([thread] * len(found), dtype="object"), "call_id": pd.Series([f[0] for f in found], dtype="int64"), "state": pd.Series([f[1] for f in found], dtype="object"), "decided_by": pd.array([f[2] for f in found], dtype="Int64")})

    def close(self) -> None:
        pass


def reviews(events: DataFrame, wait_ms: int, delay: str) -> DataFrame:
    """A stream of rows (thread_id, seq, kind: ask, approve or reject, ts) to one of changes of calls. Rows may come in any order
    within the delay; needs the RocksDB state store."""
    rows = events.where(F.col("kind").isin("ask", "approve", "reject") & F.col("ts").isNotNull()).select("thread_id", "seq", "kind", F.col("ts").cast("timestamp").alias("ts")).withColumn("at", F.unix_micros("ts"))
    return rows.withWatermark("ts", delay).groupBy("thread_id").transformWithStateInPandas(ReviewProcessor(wait_ms), CALLS, "Update", "eventtime")


def batch_reviews(events: DataFrame, wait_ms: int, until=None) -> DataFrame:
    """The last state of each call from all rows at once; until is the watermark that has been reached (null: none)."""
    calls = events.where("kind = 'ask'").select("thread_id", F.col("seq").alias("call_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    made = events.where("kind IN ('approve', 'reject')").select("thread_id", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("decided_at"), F.when(F.col("kind") == "approve", "approved").otherwise("rejected").alias("to"))
    after = (F.col("decided_at") > F.col("at")) | (F.col("decided_at") == F.col("at")) & (F.col("seq") > F.col("call_id"))
    within = F.col("decided_at") <= F.col("at") + 1000 * wait_ms
    found = calls.join(made, "thread_id", "left").groupBy("thread_id", "call_id", "at").agg(F.min(F.when(after & within, F.struct("decided_at", "seq", "to"))).alias("d"))
    over = F.lit(False) if until is None else F.coalesce(F.ceil((F.col("at") + 1000 * wait_ms) / 1000) <= until, F.lit(False))
    return found.select("thread_id", "call_id", F.when(F.col("d").isNotNull(), F.col("d.to")).when(over, "expired").otherwise("waiting").alias("state"), F.col("d.seq").alias("decided_by"))


def _pieces(bucket: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Tokens of the texts of a bucket that come in any order and repeat: of each text the contiguous ones are given once, as soon as
    none is missing before. State: the number of each text's next token, and the tokens that are early."""
    names, nexts, many, numbers, tokens = state.get if state.exists else ([], [], [], [], [])
    ends = list(accumulate(many, initial=0))
    early = {name: dict(zip(numbers[a:b], tokens[a:b], strict=True)) for name, a, b in zip(names, ends, ends[1:], strict=False)}
    first, touched = dict(zip(names, nexts, strict=True)), set()
    for batch in rows:
        for name, i, token in zip(batch["key"].tolist(), batch["i"].tolist(), batch["token"].tolist(), strict=True):
            if i >= first.setdefault(name, 0):
                early.setdefault(name, {})[i] = token
                touched.add(name)
    out = []
    for name in sorted(touched):
        own, at, found = early[name], first[name], []
        while at in own:
            found.append(own.pop(at))
            at += 1
        if found:
            out.append((name, first[name], len(found), "".join(found)))
            first[name] = at
    held = [early.get(name, {}) for name in first]
    state.update((list(first), list(first.values()), [len(x) for x in held], [i for x in held for i in x], [t for x in held for t in x.values()]))
    if out:
        yield pd.DataFrame(out, columns=["key", "first", "n", "text"])


def token_pieces(tokens: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of tokens (key, i from 0, token) to pieces of text; the pieces of a key, by first, are its text so far. A token that
    comes again is the same. Texts share a value of the state by buckets; some hundred texts a bucket are good."""
    own = tokens.where("key IS NOT NULL AND i IS NOT NULL").select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "i", F.coalesce("token", F.lit("")).alias("token"))
    kept = "key array<string>, next array<bigint>, n array<bigint>, i array<bigint>, token array<string>"
    return own.groupBy("bucket").applyInPandasWithState(_pieces, PIECES, kept, "append", "NoTimeout")


def feedback_joined(calls: DataFrame, feedback: DataFrame, within: str, delay: str) -> DataFrame:
    """Two streams, calls (call, at, ...) and feedback (call, at, ...), to one: calls with each feedback that comes `within` that
    time after them; and calls without any, once it can't come any more. Both sides forget what is over."""
    left = calls.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay).alias("c")
    right = feedback.withColumns({"fed_at": F.col("at").cast("timestamp"), "fed_call": F.col("call")}).drop("at", "call").withWatermark("fed_at", delay).alias("f")
    on = F.expr(f"c.call = f.fed_call AND f.fed_at >= c.at AND f.fed_at <= c.at + INTERVAL {within}")
    return left.join(right, on, "left_outer")

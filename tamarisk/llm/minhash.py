"""Near duplicates by HyperMinHash: compressed registers are banded, compared, and links confirmed on whole sets.

A document's distinct 5-word shingles are hashed once, and the upper bits choose a bucket. Of the least remaining value
in a bucket only its number of leading zeros and the mantissa bits after the leading one are stored. There are two such
sketches of the same hashes. The coarse one has 128 registers of 6 + 10 bits for banding: empty buckets of small sets
borrow the register of a bucket that a fixed sequence draws, and bands of 4 registers make the candidate buckets; of its
32 bands a pair of similarity 0.75 meets in none with probability 5e-6. That holds for sets of many elements; sets of at
most SMALL also take some of their hashes as keys, the first in an order that all sets share: one more than a set may lack
in common with a partner, so that any pair that is similar enough shares one. The order puts hashes of FREQUENT or more
sets last, by their number of sets, so that a phrase of many short texts makes no bucket unless they have little else. The fine one has 1024 registers of 4 + 4 bits, empty
ones marked, and gives the estimate: equal registers among those that either side fills, less expected collisions.

Copies with equal sets are one class and go on as its least id. In every candidate bucket each class is paired with
one (a star, never all pairs): the one that shares most buckets with others over all, as the original of a group of near
copies does, so that most of a group becomes one component at once. The estimate drops a pair only where it is four standard deviations too low;
what remains is confirmed on full sets. Classes are joined into components; then, in buckets that still hold several
components, members of different components are compared in blocks of bounded size. So a bucket of n near copies costs n
comparisons, and no pair that shares a bucket goes untested unless both sides are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.arrow import sliced
from tamarisk.llm.components import components
from tamarisk.llm.shingles import shingle_sets
from tamarisk.llm.tables import stored

BANDS, ROWS, FINE = 32, 4, 1024
COARSE = BANDS * ROWS
#: Sets of at most so many elements meet by prefixes; partners of theirs have a quarter to a third more.
SMALL = 64
#: Hashes of so many small sets come last in the order of prefixes.
FREQUENT = 20
BLOCK = 1_000
#: Bytes of text that are sketched at a time: a document's registers take more room than its text.
SLICE = 2 << 20
#: Collisions of unrelated registers are this times 2 ** -mantissa bits, for sets of equal size (the HyperMinHash estimate).
COLLISION = 0.169919487159739
#: So many ids are broadcast to pick their texts (8 bytes each); more are joined by a shuffle of the texts.
BROADCAST_IDS = 2_000_000


def _borrow_table(attempts: int = 64) -> np.ndarray:
    return np.random.default_rng(7).integers(0, COARSE, (attempts, COARSE))


def _compressed(least: np.ndarray, zeros_most: int, mantissa: int) -> np.ndarray:
    """Registers of 53-bit values: leading zeros (at most so many) above the bits that follow the leading one."""
    length = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    cut = np.maximum(length - mantissa - 1, 0).astype(np.uint64)
    short = np.maximum(mantissa + 1 - length, 0).astype(np.uint64)
    after = np.where(length > mantissa, least >> cut, least << short) & np.uint64((1 << mantissa) - 1)
    return np.minimum(53 - length, zeros_most).astype(np.uint64) << np.uint64(mantissa) | after


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Coarse registers (16 bits, filled; zeros for an empty set) and fine ones (8 bits, 0 where empty), a row for each set."""
    low_bits = 64 - FINE.bit_length() + 1
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if len(doc) else np.zeros(0, np.uint64)
    slot = doc * FINE + (flat >> np.uint64(low_bits)).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]  # sets are sorted: the first of a bucket is its least
    least = (flat[first] & np.uint64((1 << low_bits) - 1)) >> np.uint64(low_bits - 53)
    fine = np.zeros(len(sets) * FINE, np.uint8)
    fine[slot[first]] = np.minimum(_compressed(least, 15, 4) + np.uint64(1), 255).astype(np.uint8)
    empty = np.uint64(1 << 63)
    values = np.full(len(sets) * FINE, empty)
    values[slot[first]] = least
    values = values.reshape(-1, COARSE, FINE // COARSE).min(2)
    full = values < empty
    own = np.where(full, _compressed(np.where(full, values, np.uint64(0)), 63, 10), np.uint64(0)).astype(np.uint16)
    rows = np.flatnonzero(full.any(1) & ~full.all(1))
    if len(rows):
        some, have = own[rows], full[rows]
        filled, done = some.copy(), have.copy()
        for source in [*_borrow_table(), *((np.arange(COARSE) + i) % COARSE for i in range(1, COARSE))]:
            take = ~done & have[:, source]
            filled[take] = some[:, source][take]
            done |= take
            if done.all():
                break
        own[rows] = filled
    return own, fine.reshape(-1, FINE)


def similarity(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of fine registers, less what unrelated registers are expected to share."""
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = COLLISION / 16 * 4 * ratio / (1 + ratio) ** 2
    either = np.maximum(((a | b) > 0).sum(-1), 1)
    return (((a == b) & (a > 0)).sum(-1) / either - chance) / (1 - chance)


def plausible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """False only where sizes exclude the similarity or the estimate is four standard deviations too low for it.

    Buckets sample the union without replacement, so the deviation is the smaller the more of the union they hold.
    """
    few, many = np.minimum(n, m), np.maximum(n, m)
    j = percent / 100
    union = np.maximum((n + m) / (1 + j), 1)
    filled = np.maximum(FINE * -np.expm1(-union / FINE), 1)
    deviation = np.sqrt(j * (1 - j) / filled * np.maximum(union - filled, 0) / union)
    return (100 * few >= percent * many) & (similarity(a, b, n, m) >= j - 4 * deviation - 1.5 / filled - 0.005)


def _registers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, FINE)


def _small(s: np.ndarray, percent: int) -> np.ndarray:
    """The hashes of a set that has keys of its own: a small one, or a possible partner of such."""
    return s[:0] if 100 * SMALL < percent * len(s) else s.view(np.int64)


def _sketches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sketch_batches(batches, percent)

    return run


def _sketch_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(batch.column(1))
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        coarse, fine = ([r.tobytes() for r in x] for x in sketch(sets))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(coarse, pa.binary()), pa.array(fine, pa.binary()), pa.array([_small(s, percent) for s in sets], pa.list_(pa.int64()))], ["id", "n", "set_key", "coarse", "regs", "small"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1))], pa.binary())], ["id", "hashes"])


def _plausible_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                good = plausible(_registers(b["regs_a"]), _registers(b["regs_b"]), b["n_a"].to_numpy(), b["n_b"].to_numpy(), percent)
                yield b.select(["a", "b"]).filter(pa.array(good))

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b["set_a"], b["set_b"], strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _across(percent: int):
    """In a block: plausible pairs of a probe and a base member that are in different components.

    A pair that meets in several bands is given in the first of them only. (Had that bucket no third member, the pair has
    been tested in its star.)
    """

    def run(t: pa.Table) -> pa.Table:
        probe = t["probe"].to_numpy(zero_copy_only=False).astype(bool)
        ids, comp, n = (t[c].to_numpy() for c in ("rep", "comp", "n"))
        regs = _registers(t["regs"])
        coarse = np.frombuffer(b"".join(t["coarse"].to_pylist()), np.uint64).reshape(-1, BANDS)  # four registers each
        band = min(t["band"][0].as_py(), BANDS)
        base = np.flatnonzero(~probe)
        pairs: list[tuple[int, int]] = []
        for i in np.flatnonzero(probe).tolist():
            near = base[comp[base] != comp[i]]
            shared = np.column_stack([coarse[near] == coarse[i], np.ones(len(near), bool)])
            near = near[shared.argmax(1) == band]
            near = near[plausible(regs[near], regs[i], n[near], n[i], percent)]
            pairs += [(min(x, ids[i]), max(x, ids[i])) for x in ids[near].tolist()]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _band_keys() -> Column:
    return F.array(*[F.xxhash64(F.lit(b), F.substring("coarse", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)])


def _prefix_keys(classes: DataFrame, percent: int) -> DataFrame:
    """rep, band (BANDS), key: the prefix of each small set, its frequent hashes last."""
    own = classes.where(F.size("small") > 0).select("rep", "small")
    entries = own.select("rep", F.explode("small").alias("h"))
    frequent = stored(entries.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= FREQUENT), "frequent")
    wanted = F.broadcast(frequent) if frequent.count() <= BROADCAST_IDS // 2 else frequent
    late = entries.join(wanted, "h").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("late"))
    ordered = F.concat(F.array_except("small", F.col("late.h")), F.col("late.h"))
    least = F.size("small") - F.ceil(F.size("small") * percent / 100) + 1
    prefix = F.slice(F.coalesce(ordered, F.col("small")), F.lit(1), least.cast("int"))
    return own.join(late, "rep", "left").select("rep", F.lit(BANDS).alias("band"), F.explode(F.transform(prefix, lambda h: F.xxhash64(F.lit(-1), h))).alias("key"))


def _confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole shingle sets are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    ids = stored(ids, "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = stored(docs.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(sliced(_sets, SLICE), "id long, hashes binary"), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(sliced(_confirmed(percent)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable over links), kept (id = component_id).

    Documents are linked where 100 * common >= percent * union of their shingle sets. Null, empty and blank texts have no
    shingles and are linked with nothing. Rows that repeat an id are one document, linked by any of its texts. Rows
    without an id are linked with nothing, have no component_id and are kept. Long texts are read whole; ties do not occur, as
    links do not depend on order. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = stored(docs.mapInArrow(sliced(_sketches(percent), SLICE), "id long, n long, set_key binary, coarse binary, regs binary, small array<long>"), "sketches")
    classes = stored(marks.where("n > 0 AND id IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("coarse", "regs", "small")]), "classes")
    bands = classes.select("rep", F.posexplode(_band_keys()).alias("band", "key")).unionByName(_prefix_keys(classes, percent))
    buckets = stored(bands.groupBy("key").agg(F.count("*").alias("c"), F.min("band").alias("band")).where("c > 1"), "buckets")
    met = stored(bands.drop("band").join(buckets, "key"), "met")
    company = met.groupBy("rep").agg(F.sum("c").alias("company"))
    hubs = met.join(company, "rep").groupBy("key").agg(F.min_by("rep", F.struct(-F.col("company"), "rep")).alias("hub"))
    members = stored(met.join(hubs, "key"), "members")
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    stars = members.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    likely = stored(stars.join(side("a"), "a").join(side("b"), "b").mapInArrow(sliced(_plausible_pairs(percent)), "a long, b long"), "likely")
    links = stored(_confirm(likely, docs, percent), "links")
    labels = components(links)

    # buckets that still hold several components; with two members their pair has been tested already
    placed = stored(members.where("c > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("comp")), "placed")
    by_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("k"))
    open_keys = stored(by_comp.groupBy("key").agg(F.max_by("comp", "k").alias("most"), F.max("k").alias("top"), F.sum("k").alias("m")).where("m > top"), "open")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = placed.join(open_keys, "key").join(classes.select("rep", "n", "coarse", "regs"), "rep").select("key", "band", "rep", "comp", "n", "coarse", "regs", (F.col("comp") != F.col("most")).alias("rest"), blocks(F.col("m")).alias("nb"), blocks(F.col("m") - F.col("top")).alias("np"))
    at = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    kept = ["key", "band", "rep", "comp", "n", "coarse", "regs"]
    base = rows.select(*kept, F.lit(False).alias("probe"), at(1, "nb").alias("i"), F.explode(upto("np")).alias("j"))
    probe = rows.where("rest").select(*kept, F.lit(True).alias("probe"), F.explode(upto("nb")).alias("i"), at(2, "np").alias("j"))
    more = stored(base.unionByName(probe).groupBy("key", "i", "j").applyInArrow(_across(percent), "a long, b long").distinct().join(likely.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"), "across")
    if more.limit(1).count():
        labels = components(links.unionByName(_confirm(more, docs, percent)))

    own = classes.select("set_key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = marks.select("id", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(stored(own, "class-components"), "set_key", "left")
    by_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), by_id).alias("component_id"), (F.col("id").isNull() | (F.col("id") == by_id)).alias("kept"))

"""Benchmark decontamination by winnowing (DataFrame operations only).

A test item is cut into windows of `window` consecutive words (a shorter item is one window of its own length). Window
lengths fall into classes, a class being lengths within a factor of two; its least length t is what winnowing guarantees.
Both sides are fingerprinted for each class: k words are hashed together, and of every t - k + 1 neighbouring hashes the
least, rightmost in ties, is kept. A span of t words or more that a document shares with an item holds the same least hash
on both sides, so every such span leaves at least one common fingerprint. The corpus is scanned and cut into words once for
all classes. Fingerprints are joined, and each hit is extended: all windows that cover the hit are compared with the item
windows word for word. Work after the fingerprint join is in proportion to the hits; no pairs of a document and an item are
formed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.tables import ascii_lower, stored, whole_text

#: Fixed value: what stands between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: An item table is broadcast up to so many bytes of windows, or of fingerprints; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: So many ids are broadcast to pick the texts with hits (8 bytes each); more are joined by a shuffle of the texts.
BROADCAST_IDS = 2_000_000
#: A fingerprint is 33 bits of hash over 30 of position: no text that Spark can hold has more than 2 ** 30 words, and
#: chance hits of the hash end in the comparison of words.
POSITION_BITS, POSITION_MASK, HASH_MASK = 30, (1 << 30) - 1, (1 << 33) - 1


def words(text: Column) -> Column:
    """Splits at what stands between; an empty string comes of a text that begins or ends with it."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def _starts(n: Column, span: int) -> Column:
    """0-based starts of all spans of so many elements."""
    return F.when(n >= span, F.sequence(F.lit(0), n - span)).otherwise(F.array().cast("array<int>"))


def _gram(ws: Column, at: Column, span: int | Column) -> Column:
    """The words of a span, joined; equal exactly if the words are."""
    return F.array_join(F.slice(ws, at + 1, span), " ")


def _grams(ws: Column, span: int) -> Column:
    return F.transform(_starts(F.size(ws), span), lambda i: _gram(ws, i, span))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once though use mentions it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashed_words(ws: Column) -> Column:
    return F.transform(ws, lambda x: F.xxhash64(x))


def gram_size(t: int) -> int:
    """Words that are hashed together where spans of t words must be found: half of them, but up to three all."""
    return max((t + 1) // 2, min(t, 3))


def fingerprints(hashes: Column, t: int) -> Column:
    """What winnowing keeps of hashed words: distinct longs, hash in the upper bits and position in the lower.

    Hashes of different t have nothing in common.
    """
    k = gram_size(t)

    def gram(x: Column, i: Column) -> Column:
        # the position counts down, so that the least of a window is the least hash at its rightmost place
        own = F.xxhash64(F.lit(t), x, *[F.get(hashes, i + j) for j in range(1, k)])
        return F.shiftleft(own.bitwiseAND(F.lit(HASH_MASK)), POSITION_BITS).bitwiseOR(F.lit(POSITION_MASK) - i)

    def least(grams: Column) -> Column:
        if t == k:
            return grams
        return F.transform(grams, lambda x, i: F.least(x, *[F.get(grams, i + j) for j in range(1, t - k + 1)]))

    # what begins too near to the end is no whole window
    windows = F.slice(_let(F.transform(hashes, gram), least), F.lit(1), F.greatest(F.size(hashes) - (t - 1), F.lit(0)))
    return windows if t == k else F.array_distinct(windows)


def print_hash(f: Column) -> Column:
    return F.shiftright(f, POSITION_BITS)


def print_position(f: Column) -> Column:
    return (F.lit(POSITION_MASK) - f.bitwiseAND(F.lit(POSITION_MASK))).cast("int")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row per document id: id, n_words, n_hit, items (sorted array of item ids as strings), contaminated, spans.

    n_hit counts the words inside any occurrence of any item window; spans are the hit windows as (position, length).
    Null or empty texts have no words: they are clean, and such items match nothing. Long texts are read whole. Repeated
    items count once; rows that repeat a document id are judged together (n_words is the largest, hits are those of any of
    them), rows without an id are one such group. Empty tables: no documents give no rows, no items leave all documents
    clean. Other columns are ignored, whatever their names.
    """
    test = stored(items.select(F.col(item_id).cast("string").alias("item"), words(whole_text(item_text)).alias("ws")).where(F.size("ws") > 0).withColumn("t", F.least(F.size("ws"), F.lit(window))), "items")
    # no more than `window` distinct lengths
    lengths = sorted(r[0] for r in test.select("t").distinct().collect())
    base = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    if lengths:
        least = _classes(lengths)
        windows = stored(reduce(DataFrame.unionByName, [test.where(F.col("t") == t).select("item", F.explode(F.array_distinct(_grams(F.col("ws"), t))).alias("gram")) for t in lengths]), "windows")
        grams = stored(windows.select("gram").distinct().withColumn("g", F.monotonically_increasing_id()), "grams")
        marked = _marked(base, _prints(test, least), sorted(set(least.values())))
        hits = _hits(base, marked, _small(grams, F.octet_length("gram") + 32), least)
        of_item = windows.join(_small(grams, F.octet_length("gram") + 32), "gram").select("g", "item")
        counts = marked.select("id", "n_words")
        spans = hits.select("id", F.struct("at", "t").alias("span")).distinct()
        found = hits.select("id", "g").distinct().join(_small(stored(of_item, "of-items"), F.octet_length("item") + 32), "g").select("id", "item").distinct()
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        told = [
            counts.select("id", "n_words", none("span", "struct<at:int,t:int>"), none("item", "string")), spans.select("id", none("n_words", "long"), "span", none("item", "string")),
            found.select("id", none("n_words", "long"), none("span", "struct<at:int,t:int>"), "item"),
        ]
        out = reduce(DataFrame.unionByName, told).groupBy("id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_list("span")).alias("spans"), F.array_sort(F.collect_list("item")).alias("items"))
    else:
        n_words = F.max(F.size(words(F.col("text")))).cast("long")
        out = base.groupBy("id").agg(n_words.alias("n_words")).select("*", F.array().cast("array<struct<at:int,t:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["t"] - 1)))))
    return out.select(F.col("id").alias(id_col), "n_words", covered.cast("long").alias("n_hit"), "items", (F.size("spans") > 0).alias("contaminated"), "spans")


def _classes(lengths: list[int]) -> dict[int, int]:
    """For each window length the least one of its class: those within the same power of two."""
    least: dict[int, int] = {}
    for t in sorted(lengths):
        least[t] = next((m for m in least.values() if m.bit_length() == t.bit_length()), t)
    return least


def _small(df: DataFrame, size: Column) -> DataFrame:
    """A table of the items, with a hint to broadcast it where its bytes are few."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def _prints(test: DataFrame, least: dict[int, int]) -> DataFrame:
    """Fingerprint hashes of the items (h), with the class (m) that they are of."""
    own = [test.where(F.col("t").isin([t for t in least if least[t] == m])).select(F.explode(fingerprints(hashed_words(F.col("ws")), m)).alias("f"), F.lit(m).alias("m")) for m in sorted(set(least.values()))]
    return _small(stored(reduce(DataFrame.unionByName, own).select(print_hash(F.col("f")).alias("h"), "m").distinct(), "prints"), F.lit(32))


def _marked(docs: DataFrame, prints: DataFrame, classes: list[int]) -> DataFrame:
    """id, n_words, ps: the places (class m, position p) where a fingerprint of the items occurs. The texts are split into words once."""
    # beside its fingerprints, a document sends one negative number, which carries its number of words
    sent = _let(hashed_words(words(F.col("text"))), lambda hs: F.concat(*[fingerprints(hs, m) for m in classes], F.array(-F.size(hs).cast("long") - 1)))
    marks = docs.select("id", F.explode(sent).alias("f"))
    count = F.col("f") < 0
    found = marks.select("id", "f", F.when(count, F.xxhash64("id")).otherwise(print_hash(F.col("f"))).alias("h")).join(prints, "h", "left").where(count | F.col("m").isNotNull())
    place = F.when(~count, F.struct("m", print_position(F.col("f")).alias("p")))
    return stored(found.groupBy("id").agg(F.max(F.when(count, -F.col("f") - 1)).alias("n_words"), F.collect_set(place).alias("ps")), "marked")


def _hits(docs: DataFrame, marked: DataFrame, grams: DataFrame, least: dict[int, int]) -> DataFrame:
    """Occurrences of item windows: id, at, t, g (the window's number)."""

    def covering(x: Column) -> Column:
        # every window that covers the words of the fingerprint, of every length of its class
        none = F.array().cast("array<struct<at:int,t:int>>")
        of = lambda t, m: F.transform(F.sequence(F.greatest(x["p"] - (t - gram_size(m)), F.lit(0)), x["p"]), lambda at: F.struct(at.alias("at"), F.lit(t).alias("t")))
        return F.concat(*[F.when(x["m"] == m, of(t, m)).otherwise(none) for t, m in least.items()])

    places = marked.where(F.size("ps") > 0).select(F.col("id").alias("place_id"), F.array_distinct(F.flatten(F.transform("ps", covering))).alias("windows"))
    # texts without a hit are left where they are
    ids = stored(places.select("place_id"), "hit-ids")
    wanted = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    near = docs.join(wanted, F.col("id").eqNullSafe(F.col("place_id")), "left_semi").join(places, F.col("id").eqNullSafe(F.col("place_id"))).select("id", words(F.col("text")).alias("ws"), "windows")
    cut = F.transform("windows", lambda w: F.struct(w["at"].alias("at"), w["t"].alias("t"), _gram(F.col("ws"), w["at"], w["t"]).alias("gram"), (w["at"] + w["t"] <= F.size("ws")).alias("whole")))
    spans = near.select("id", F.explode(cut).alias("x")).where("x.whole").select("id", "x.at", "x.t", "x.gram")
    return stored(spans.join(grams, "gram").select("id", "at", "t", "g"), "hits")

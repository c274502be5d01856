"""Exact duplicates by a tree-merge of sorted digest runs (DataFrame operations only).

The scan tasks are dealt to runs 0 .. fan_in ** rounds - 1, about as many as the session has shuffle partitions. Digest
ranges have the same numbers. In round r the r-th digit of a run's number is replaced by that digit of the entry's digest
range: partners whose numbers differ in that digit alone exchange the entries of each other's ranges, and each is a node
that merges what it gets, sorted by digest, into one verified entry for a digest. With fan_in = 2, the default, these are
the rounds of a binomial exchange: each run has one partner a round and keeps one half of the ranges. The node is the only
key of the exchange, so a node is one task. It gets fan_in runs at most, whatever their digests: of a digest that a third
of all rows share, a third of each run and later one entry of each. After the last round a node holds one digest range of
the whole table, so none ever gathers the corpus.

An entry holds the count and the smallest identifier among the longest originals. Entries merge only where the SHA-256
digest and the byte length of the normalised text agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.tables import shuffle_partitions, stored, whole_text

#: The characters that normalisation deletes: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = (" ", "\t", "\n", "\x0b", "\f", "\r")


def normalised(text: Column) -> Column:
    """Byte-wise deletes; cheaper than a regular expression over long texts."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _digit(number: Column, place: int, base: int) -> Column:
    return F.pmod(F.shiftright(number, place * (base.bit_length() - 1)), F.lit(base))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 2, rounds: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_chars.

    Of equal texts the row with most code points, then the smallest id stays. Null texts are empty texts; empty texts
    are equal to each other. A null id comes after all others, so it stays only if its whole group has none (keep_id
    is null then); of rows that repeat both id and text, all carry kept alike. An empty table gives an empty result.
    Texts are read whole whatever their length, and only digests are exchanged. Other columns are ignored, whatever their
    names. fan_in is a power of two; without a number of rounds there are enough for the session's shuffle partitions.
    """
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in must be a power of two")
    if rounds is None:
        rounds = 1
        while fan_in**rounds < shuffle_partitions(docs.sparkSession):
            rounds += 1
    runs = fan_in**rounds
    text = whole_text(text_col)
    norm = normalised(text)
    rows = stored(
        docs.select(F.col(id_col).cast("long").alias("id"), F.char_length(text).cast("long").alias("n_chars"), norm.alias("norm"), F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"))
        .select("id", "n_chars", "run", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").alias("norm_bytes")),
        "digests",
    )
    key = ["digest", "norm_bytes"]
    # bitwise not turns the order of ids round without overflow; null sorts below all, so it loses in max()
    entries = rows.select("run", *key, F.struct("n_chars", F.bitwise_not("id").alias("inverse")).alias("best"), F.lit(1).cast("long").alias("n"))
    part = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    for r in range(rounds):
        number = F.col("run").cast("long")
        node = number + (_digit(part, r, fan_in) - _digit(number, r, fan_in)) * fan_in**r
        entries = entries.withColumn("run", node.cast("int")).repartitionById(runs, F.col("run")).groupBy("run", *key).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    winners = entries.select(*key, F.bitwise_not(F.col("best.inverse")).alias("keep_id"), F.col("n").alias("group_size"))
    # the way down: each run learns the winners of its own digests, then its rows do; a frequent digest is met run by run
    told = rows.select("run", *key).distinct().join(winners, key)
    out = rows.join(told, ["run", *key])
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_chars",
    )

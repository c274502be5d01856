"""Document fingerprints by one-permutation MinHash (DataFrame operations only).

Every 5-word shingle is hashed once; the upper bits of the hash name its bin, and a bin keeps its least hash. A bin that no
shingle falls into is filled by optimal densification: it probes the bins in an order of its own, (a t + c) mod BINS for
t = 0, 1, ... with constants drawn for each bin, and takes what the first filled one holds. So all empty bins choose
independently, and two texts with the same filled bins choose alike. Of each bin the BITS low-order bits are stored, packed
into longs. Unrelated bins agree in BITS bits once in 2 ** BITS, which the likeness of two fingerprints is corrected for.

Hashes of a text are sorted once, together with the greatest value of every bin, so that each bin has one and the first of
each bin is its least. Where PROBES probes find nothing, the filled bin of the least place in the order is looked up, which
is the one that further probes would come to: sets of few shingles would need many.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm.tables import held, let_go, passed_through, shuffle_partitions, whole_text

SHINGLE = 5
BIN_BITS, BITS = 8, 4
BINS, LEVELS = 1 << BIN_BITS, 1 << BITS
#: Bins in a long.
PACKED = 64 // BITS
BETWEEN = r"[\x20\x09-\x0D]+"
#: Probes that are tried one after the other.
PROBES = 10

_DRAWN = random.Random(13)
STEP = [2 * _DRAWN.randrange(BINS // 2) + 1 for _ in range(BINS)]
START = [_DRAWN.randrange(BINS) for _ in range(BINS)]
#: The place of bin j in the order of bin i is (j - START[i]) * BACK[i] mod BINS.
BACK = [pow(a, -1, BINS) for a in STEP]
#: What a bin holds that no shingle falls into: the greatest hash of the bin. Bins are numbered from the least signed hash.
NOTHING = [((i - BINS // 2 + 1) << (64 - BIN_BITS)) - 1 for i in range(BINS)]


def _let(value: Column, use) -> Column:
    """use(value), with value computed once though use mentions it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """A hash of each 5-word shingle in order, repeats included; one of all words where there are fewer, none without words."""
    words = F.transform(F.array_remove(F.split(F.lower(text), BETWEEN), ""), lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))
        return F.when(F.size(h) >= SHINGLE, each).otherwise(F.slice(F.array(F.xxhash64(h)), F.lit(1), F.least(F.size(h), F.lit(1))))

    return _let(words, grams)


def binned(ordered: Column) -> Column:
    """The first hash of each bin, of hashes in order: the one that follows the greatest value of the bin before."""
    tail = F.lit((1 << (64 - BIN_BITS)) - 1)
    return F.filter(ordered, lambda _, i: (i == 0) | (F.get(ordered, i - 1).bitwiseAND(tail) == tail))


def bits_of(bins: Column) -> Column:
    """The low-order bits of each bin; -1 where nothing fell into it."""
    return F.transform(bins, lambda x, i: F.when(x == F.get(F.lit(NOTHING), i), F.lit(-1)).otherwise(x.bitwiseAND(F.lit(LEVELS - 1)).cast("int")))


def densified(bits: Column) -> Column:
    """The bits of each bin, empty ones filled; null if all are empty."""
    probe = lambda i, t: F.get(F.lit([(STEP[j] * t + START[j]) % BINS for j in range(BINS)]), i)

    def fill(filled: Column) -> Column:
        def nearest(i: Column) -> Column:
            place = lambda j: ((j - F.get(F.lit(START), i)) * F.get(F.lit(BACK), i)).bitwiseAND(F.lit(BINS - 1))
            return F.get(bits, F.array_min(F.transform(filled, lambda j: place(j) * BINS + j)).bitwiseAND(F.lit(BINS - 1)))

        def taken(x: Column, i: Column) -> Column:
            out = F.when(x >= 0, x)
            for t in range(PROBES):
                out = out.when(F.get(bits, probe(i, t)) >= 0, F.get(bits, probe(i, t)))
            return out.otherwise(nearest(i))

        return F.when(F.size(filled) == BINS, bits).when(F.size(filled) > 0, F.transform(bits, taken))

    return _let(F.filter(F.lit(list(range(BINS))), lambda i: F.get(bits, i) >= 0), fill)


def packed(bits: Column) -> Column:
    """The bits of PACKED bins in each long, the first bin in the highest bits."""
    own = lambda b: F.slice(bits, b * PACKED + 1, F.lit(PACKED))
    joined = lambda b: F.aggregate(own(b), F.lit(0).cast("long"), lambda z, x: F.shiftleft(z, BITS).bitwiseOR(x.cast("long")))
    return F.when(bits.isNotNull(), F.transform(F.lit(list(range(BINS // PACKED))), joined))


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with the fingerprint of a text column as an array of longs; null for a text without words.

    The sort stands in a step of its own, outside of lambda functions, so that it runs compiled, on primitive values.
    """
    ordered = df.withColumn("_ordered", F.sort_array(F.concat(shingle_hashes(F.col(text_col)), F.lit(NOTHING))))
    bins = ordered.withColumn("_bits", bits_of(binned(F.col("_ordered")))).drop("_ordered")
    return bins.withColumn(out, _let(densified(F.col("_bits")), packed)).drop("_bits")


def written(prints: Column) -> Column:
    """A fingerprint as text, a hexadecimal digit for each bin; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(prints, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit(""))


def likeness(p: Column, q: Column) -> Column:
    """The Jaccard estimate from two fingerprints, 0 to 1: the share of equal bins, less what chance makes equal.

    Texts without words are like each other, and unlike others.
    """
    ones = F.lit(int("1" * 16, 16))

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(ones))

    equal = 1 - F.aggregate(F.zip_with(p, q, unequal), F.lit(0), lambda a, b: a + b) / F.lit(BINS)
    estimate = F.greatest((equal - 1 / LEVELS) / (1 - 1 / LEVELS), F.lit(0.0))
    return F.when(p.isNull() | q.isNull(), (p.isNull() & q.isNull()).cast("double")).otherwise(estimate)


def fingerprints(docs: DataFrame, text_col: str = "text", columns: list[str] | tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of every row, and fingerprint (text) of its whole text. Equal texts have equal ones.

    Null and empty texts, and texts of white space alone, have an empty fingerprint. Long texts are read whole; rows that
    repeat are treated alike; an empty table gives no rows. A column fingerprint of the input gives way to the result.
    """
    columns = passed_through(docs, list(columns), ("fingerprint",))
    own = with_fingerprint(docs.select(held(columns), whole_text(text_col).alias("text")), "text", "prints")
    return own.select(*let_go(columns), written(F.col("prints")).alias("fingerprint"))


def _dealt(ids: DataFrame, buckets: int) -> tuple[list[int], dict[int, int]]:
    """Bounds of about equal ranges of ids, and the greatest id of each range that has any: a few numbers a bucket."""
    at = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(ids.select(F.percentile_approx("id", at, 100 * buckets)).first()[0] or [])) if at else []
    return bounds, {r.bucket: r.head for r in ids.where("id IS NOT NULL").groupBy(_bucket(bounds).alias("bucket")).agg(F.max("id").alias("head")).collect()}


def _bucket(bounds: list[int]) -> Column:
    """Number of the range that an id lies in, counted from the greatest ids; rows without an id are in the last."""
    ends = F.lit(bounds).cast("array<long>") if bounds else F.array().cast("array<long>")
    low = F.aggregate(ends, F.lit(0), lambda k, e: k + (e < F.col("id")).cast("int"))
    return F.when(F.col("id").isNull(), F.lit(len(bounds))).otherwise(F.lit(len(bounds)) - low)


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the code points (rounded down) replaced by as many first ones of the next
    document, or all it has. Documents follow each other by descending id, those that repeat an id by text, those without
    an id at the end by text; after the last comes the first. Null texts are empty; texts are read whole, however long;
    where no row has an id at all, nothing follows the last. An empty table gives no rows; other columns are ignored,
    whatever their names. Texts are shuffled once, by ranges of ids, of which the driver knows only the bounds.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    buckets = shuffle_partitions(docs.sparkSession)
    bounds, heads = _dealt(rows.select("id"), buckets)
    # the first document of each range is also the next one of the last document in the range before
    used = sorted(heads)
    before = {heads[b]: used[k - 1] for k, b in enumerate(used)}
    guest_in = F.lit(None).cast("int")
    own = with_fingerprint(rows, "text", "prints").withColumn("bucket", _bucket(bounds))
    if before:
        places = F.create_map(*[F.lit(x) for pair in sorted(before.items()) for x in pair])
        guest_in = F.when(F.col("id").isin(list(before)), F.element_at(places, F.col("id")))
    copies = F.filter(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")), F.struct(guest_in.alias("bucket"), F.lit(True).alias("guest"))), lambda x: x["bucket"].isNotNull())
    dealt = own.select("id", "text", "prints", F.explode(copies).alias("at")).select("id", "text", "prints", "at.bucket", "at.guest").repartitionById(buckets, F.col("bucket"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), "text")
    placed = dealt.select("*", F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text"), F.lead("prints").over(order).alias("next_prints")).where("NOT guest")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    whole = placed.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "prints", "next_prints")
    both = with_fingerprint(whole, "edited", "edited_prints").withColumn("edited_sha256", F.sha2("edited", 256))
    return both.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", written(F.col("prints")).alias("fingerprint"), written(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"), likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )

"""Phrase collocations by suffix-sigma: all counts of phrases from one sorted pass over truncated suffixes.

From every word of a text its suffix within the piece starts, cut to `most` words. Suffixes, with how often they occur in a
slice of texts, are dealt by language and first word and sorted in reverse lexicographic order. There every phrase comes
before its beginnings, so one stack of open prefixes for each language counts them all: when the first k words change, the
count of that prefix is complete. Batches are counted with numpy, equal prefixes lying side by side; only the prefixes that
are open at the end of a batch stay on the stack.

A first word of very many suffixes (HOT_SHARE of a task's share of all words) is dealt over several tasks by its further
words, and what they count of its phrases is added up. So no task holds more than its share, whatever one word or one pair
of words makes up. Then the counts of both parts of each candidate are joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm.arrow import in_slices, texts_of
from tamarisk.llm.tables import shuffle_partitions, stored

#: Bytes that end a piece, and those between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: A first word is hot if it has more than this part of a task's share of the corpus; then it takes so many tasks that none
#: has more.
HOT_SHARE = 0.25
#: First words of fewer suffixes are never dealt out.
HOT_LEAST = 20_000
#: Bytes of text that are counted at a time.
SLICE = 4 << 20
#: Tables of so many rows are broadcast (counts of a phrase take about 50 bytes); larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Rows of a language are ranked in so many groups, then in the next number of groups, and at last together.
RANK_GROUPS = (1024, 64, 4)

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(BLANKS)] = 1
_CLASS[list(BREAKS)] = 2


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text and piece of each word, its code, and the distinct words. A-Z are lower-cased; nulls have no words."""
    texts = texts_of(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_binary())
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy()
    offsets = offsets - offsets[0]
    data[(data >= 65) & (data <= 90)] += 32
    kind = _CLASS[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = inside[first]  # a text begins a word of its own
    start = np.flatnonzero(begins)
    text = np.searchsorted(offsets, start, side="right") - 1
    piece = np.cumsum(kind == 2)[start] + text
    bounds = np.append(np.cumsum(inside)[start] - 1, inside.sum()).astype(np.int64) if len(start) else np.zeros(1, np.int64)
    own = data[inside]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(own)]).dictionary_encode()
    return text, piece, words.indices.to_numpy().astype(np.int64), words.dictionary


def _languages(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.cast(pa.string()).fill_null("und").dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _frequent_words(share: float):
    """lang, word, c of the words that make up at least this share of a slice; and without a word the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, SLICE):
            lang, languages = _languages(batch.column(0))
            text, _, code, words = words_of(batch.column(1))
            width = max(len(words), 1)
            keys, counts = np.unique(lang[text] * width + code, return_counts=True)
            often = counts >= share * len(code)
            keys, counts = keys[often], counts[often]
            names = [*(x.as_py().decode() for x in words.take(pa.array(keys % width))), None]
            yield pa.RecordBatch.from_arrays([pa.array([*languages.take(pa.array(keys // width)).to_pylist(), None], pa.string()), pa.array(names, pa.string()), pa.array([*counts.tolist(), len(code)], pa.int64())], ["lang", "word", "c"])

    return run


def _hashed(names: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """A number from several, the same in every task."""
    out = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (out ^ p) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return (out >> np.uint64(1)).astype(np.int64)


def _suffix_rows(most: int, parts: int, salts):
    """part, suffix, c2 of each distinct suffix in a slice. A space follows each word of a suffix, so that those with equal
    first words stand side by side when sorted; at its end, behind a tab, which no word holds, is its language in hexadecimal digits. part is the task
    that counts it. c2 is twice the count, and 1 more where other tasks count further suffixes of the same first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, SLICE):
            lang, languages = _languages(batch.column(0))
            text, piece, code, words = words_of(batch.column(1))
            n, width = len(code), len(words) + 1
            if not n:
                continue
            columns = [code + 1]  # 0 where the piece has ended
            for k in range(1, most):
                later = np.zeros(n, np.int64)
                same = np.flatnonzero(piece[k:] == piece[:-k]) if n > k else np.zeros(0, np.int64)
                later[same] = code[same + k] + 1
                columns.append(later)
            own = lang[text]
            if len(languages) * width**most < 1 << 62:
                number = own
                for c in columns:
                    number = number * width + c
                number, counts = np.unique(number, return_counts=True)
                taken = []
                for _ in range(most):
                    number, c = np.divmod(number, width)
                    taken.append(c)
                own, columns = number, taken[::-1]
            else:  # numbered anew after each word
                number = own
                for c in columns:
                    number = np.unique(number, return_inverse=True)[1] * width + c
                _, place, counts = np.unique(number, return_index=True, return_counts=True)
                own, columns = own[place], [c[place] for c in columns]
            strings = words.cast(pa.large_string()).cast(pa.string())
            spread = np.ones((len(languages), width), np.int64)
            for i, name in enumerate(languages.to_pylist()):
                hot = salts.value.get(name, {})
                for word, over in zip(pc.index_in(pa.array(list(hot), pa.string()), value_set=strings).to_pylist(), hot.values(), strict=True):
                    if word is not None:
                        spread[i, word + 1] = over
            times = spread[own, columns[0]]
            of_word = np.concatenate([np.zeros(1, np.uint64), _hashed(words.to_pylist())])
            of_lang = _hashed([x.encode() for x in languages.to_pylist()])
            salt = np.where(times > 1, _mixed([of_word[c] for c in columns[1:]] or [of_word[columns[0]]]) % times, 0)
            part = _mixed([of_lang[own], of_word[columns[0]], salt.astype(np.uint64)]) % parts
            tails = pa.array(["\t" + x.encode().hex() for x in languages.to_pylist()], pa.string()).take(pa.array(own))
            suffix = pc.binary_join_element_wise(*[strings.take(pa.array(c - 1, mask=c == 0)) for c in columns], tails, " ", null_handling="skip")
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), suffix, pa.array(2 * counts + (times > 1))], ["part", "suffix", "c2"])

    return run


class _Stack:
    """The prefixes that are open in one language: the words of the last suffix, and the count so far of each of its beginnings."""

    def __init__(self, most: int, least: int) -> None:
        self.most, self.least = most, least
        self.words: list[str] | None = None
        self.count, self.split = [0] * (most + 1), False

    def _done(self, k: int, phrase: str | None, f: int, split: bool) -> Iterator[tuple]:
        if phrase is not None and (split or f >= self.least or not k):
            yield k, phrase, f, bool(k and not split)

    def close(self) -> Iterator[tuple]:
        for k in range(self.most + 1 if self.words is not None else 0):
            yield from self._done(k, " ".join(self.words[:k]) if k <= len(self.words) else None, self.count[k], self.split)

    def add(self, begin: np.ndarray, size: np.ndarray, words: pa.Array, code: np.ndarray, split: np.ndarray, c: np.ndarray) -> Iterator[tuple]:
        """Of sorted suffixes, given by their places and numbers of words: k, phrase, f and whole of the prefixes that are
        complete, leaving out the rare ones."""
        new = np.zeros(len(c), bool)
        last = self.words
        for k in range(self.most + 1):
            if k:
                at = np.where(size >= k, code[np.minimum(begin + k - 1, len(code) - 1)], -1)
                new[1:] |= at[1:] != at[:-1]
                first = words[int(begin[0]) + k - 1].as_py() if size[0] >= k else None
                new[0] |= first != (last[k - 1] if last is not None and k <= len(last) else None)
            if last is None:
                new[0] = True
            start = np.flatnonzero(new) if new[0] else np.concatenate([[0], np.flatnonzero(new)])
            sums = np.add.reduceat(c, start)
            if not new[0]:
                sums[0] += self.count[k]
            elif last is not None:
                yield from self._done(k, " ".join(last[:k]) if k <= len(last) else None, self.count[k], self.split)
            kept = np.flatnonzero((split[start[:-1]] | (sums[:-1] >= self.least)) & (size[start[:-1]] >= k))
            own = words.take(pa.array((begin[start[kept]][:, None] + np.arange(k)).ravel())).to_pylist()
            for i, (f, shared) in enumerate(zip(sums[kept].tolist(), split[start[kept]].tolist(), strict=True)):
                yield from self._done(k, " ".join(own[k * i : k * i + k]), f, shared)
            self.count[k] = int(sums[-1])
        self.words, self.split = words[int(begin[-1]) : int(begin[-1] + size[-1])].to_pylist(), bool(split[-1])


def _prefixes(most: int, least: int):
    """Counts of all prefixes of sorted suffixes: lang, k, phrase, f, whole (false if other tasks may have more of it).

    k = 0 counts all words of a language. Prefixes that are whole and occur fewer than `least` times are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacks: dict[str, _Stack] = {}

        def rows(lang: str, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            if own := list(found):
                k, phrase, f, whole = zip(*own, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(k, pa.int32()), pa.array(phrase, pa.string()), pa.array(f, pa.int64()), pa.array(whole)], ["lang", "k", "phrase", "f", "whole"])

        for batch in batches:
            if not batch.num_rows:
                continue
            suffixes = batch.column(0)
            lists = pc.split_pattern(suffixes if not suffixes.offset else suffixes.take(pa.array(np.arange(len(suffixes)))), " ")
            offsets, words = lists.offsets.to_numpy(), lists.flatten()
            coded = words.dictionary_encode()
            code, c2 = coded.indices.to_numpy(), batch.column(1).to_numpy()
            tail = code[offsets[1:] - 1]
            for i in np.unique(tail).tolist():
                own = np.flatnonzero(tail == i)
                lang = bytes.fromhex(coded.dictionary[i].as_py()[1:]).decode()
                stack = stacks.setdefault(lang, _Stack(most, least))
                yield from rows(lang, stack.add(offsets[own], offsets[own + 1] - offsets[own] - 1, words, code, c2[own] % 2 > 0, c2[own] // 2))
        for lang, stack in stacks.items():
            yield from rows(lang, stack.close())

    return run


def _hot(own: DataFrame, parts: int) -> dict[str, dict[str, int]]:
    """Of each language the first words that are dealt out, and over how many tasks. What a slice has too little of is not
    counted, so a quarter of the share may be missing: fewer than 2 parts / HOT_SHARE words are."""
    share = HOT_SHARE / parts
    words = stored(own.mapInArrow(_frequent_words(share / 4), "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c")), "words")
    total = words.where("word IS NULL").agg(F.sum("c")).first()[0] or 0
    most = max(HOT_LEAST, share * total) * 3 / 4
    out: dict[str, dict[str, int]] = {}
    for r in words.where(F.col("word").isNotNull() & (F.col("c") > most)).collect():
        out.setdefault(r.lang, {})[r.word] = int(-(-r.c // most))
    return out


def phrase_counts(docs: DataFrame, most: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, k, phrase, f: how often every phrase of k words, 1 to `most`, occurs in pieces of a language; those of at least
    `least` times. The row of k = 0 and an empty phrase has the number of all words of the language.

    Null texts have no words, null languages are `und`; texts are read whole; rows that repeat count again; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    salts = spark.sparkContext.broadcast(_hot(own, parts))
    suffixes = own.mapInArrow(_suffix_rows(most, parts, salts), "part int, suffix string, c2 long")
    ordered = suffixes.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("suffix").desc()).select("suffix", "c2")
    counts = stored(ordered.mapInArrow(_prefixes(most, least), "lang string, k int, phrase string, f long, whole boolean"), "phrases")
    parted = counts.where("NOT whole").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("k") == 0) | (F.col("f") >= least))
    return counts.where("whole").drop("whole").unionByName(parted)


def _joined(left: DataFrame, counts: DataFrame, phrase: str, out: str) -> DataFrame:
    """left with the count of a phrase of its language."""
    right = counts.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(out))
    return left.join(right, ["lang", phrase])


def cut_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exactly: counts are below 10 ** 14, so no product has more than 38 digits."""
    return F.expr(f"CAST((CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(14,0)) * CAST({a} AS DECIMAL(14,0))) div (CAST({left} AS DECIMAL(14,0)) * CAST({right} AS DECIMAL(14,0))) AS BIGINT)")


def collocations(docs: DataFrame, most: int = 3, least: int = 10, top: int = 2000, percent: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first `top` phrases of 2 to `most` words by score.

    a is the count of the phrase, l and r those of the parts that its lowest-scoring cut makes (of equal ones the first), n
    the number of words. A phrase that stands in a longer candidate with at least `percent` of its count is left out.
    Ties go by a, then by phrase in byte order. See phrase_counts for nulls, long texts and empty tables.
    """
    counts = stored(phrase_counts(docs, most, least, lang_col, text_col), "counts")
    candidates = counts.where("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    # what stands in longer candidates
    inner = lambda k: F.transform(F.sequence(F.lit(1), F.col("k") - k + 1), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
    within = [candidates.where(F.col("k") > k).select("lang", F.explode(F.array_distinct(inner(k))).alias("phrase"), "a") for k in range(2, most)]
    if within:
        longer = reduce(DataFrame.unionByName, within).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        candidates = candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("cut"), F.array_join(F.slice(words, F.lit(1), i), " ").alias("head"), F.array_join(F.slice(words, i + 1, F.col("k") - i), " ").alias("tail")))
    each = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.cut", "c.head", "c.tail")
    parts = counts.where((F.col("k") > 0) & (F.col("k") < most))
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    both = _joined(_joined(each, parts, "head", "l"), parts, "tail", "r").withColumn("score", cut_score("a", "l", "r"))
    lowest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    for groups in RANK_GROUPS:
        own = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(F.desc("score"), F.desc("a"), "phrase")
        lowest = lowest.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).drop("rank")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    # a row for each language
    totals = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

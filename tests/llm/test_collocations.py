"""op12 against plain Python: counts, cuts, hot words dealt over tasks, and the edges."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tamarisk.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, most=3):
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^ \t]+", piece)
            for k in range(1, most + 1):
                f.update(("und" if lang is None else lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    return f


def plain(rows, least=10, top=2000, most=3):
    f = counted(rows, most)
    n = Counter()
    for (lang, p), c in f.items():
        n[lang] += c if len(p) == 1 else 0
    longer = Counter()
    for (lang, p), c in f.items():
        if c >= least:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], c)
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least or 100 * longer[lang, p] >= 50 * a:
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right, n[lang]))
    rank = Counter()
    found = []
    for lang, score, a, p, left, right, words in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], p.decode(), -a, left, right, words, -score))
    return found


def corpus(seed, n=250):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [r.choice(("the", "The", "of", "new york", "New York City", "über", f"w{r.randrange(12)}", f"w{r.randrange(40)}", "a\x00b", "l'été", "x-y")) + r.choice(("", "", "", "", ",", ".", "\n", "\t", "!", "\x0b")) for _ in range(r.choice((0, 1, 2, 3, 10, 80)))]
        rows.append((r.choice(("en", "en", "de", None, "und", "", "a b")), r.choice((" ", "  ")).join(words)))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 5, "p", 1, None) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, k int, phrase string, f long, w1 string").repartition(3)


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("hot", [20_000, 100])
def test_against_plain_python(spark, monkeypatch, hot):
    monkeypatch.setattr(co, "HOT_LEAST", hot)
    monkeypatch.setattr(co, "SLICE", 3_000)
    rows = [*corpus(2), (None, None), ("en", ""), ("de", " \t"), ("en", "so long " * 30_000), ("en", "one sentence that repeats ten times. " * 12)]
    assert found(co.collocations(table(spark, rows))) == plain(rows)


def test_shuffled_joins_and_the_top(spark, monkeypatch):
    monkeypatch.setattr(co, "BROADCAST_ROWS", 0)
    rows = corpus(7)
    assert found(co.collocations(table(spark, rows), top=9)) == plain(rows, top=9)
    assert found(co.collocations(table(spark, rows), most=4, least=3, top=50)) == plain(rows, 3, 50, 4)


def test_ties_repeats_and_empty_tables(spark):
    rows = [("en", "b a. c d. d c"), ("en", "c d")] * 10
    assert found(co.collocations(table(spark, rows))) == plain(rows)
    assert co.collocations(table(spark, rows).limit(0)).count() == 0
    assert co.collocations(table(spark, [(None, None), ("en", "one two")])).count() == 0


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13 - 1, 10**13, 3 * 10**13), (7, 7, 7), (10, 99_999_999_999_999, 99_999_999_999_999)], "a long, l long, r long")
    assert [r.s for r in df.select("a", co.cut_score("a", "l", "r").alias("s")).orderBy("a").collect()] == [10**6, 0, 10**6 * (10**13 - 1) ** 2 // (3 * 10**26)]


def test_words_of_slices():
    texts = pa.array(["skipped one", "A b,c\td", None, "", "e", ".f.", "g h"], pa.large_string()).slice(1)
    text, piece, code, words = co.words_of(texts)
    assert [words[int(c)].as_py().decode() for c in code] == ["a", "b", "c", "d", "e", "f", "g", "h"]
    assert text.tolist() == [0, 0, 0, 0, 3, 4, 5, 5]
    assert [bool(x) for x in piece[1:] == piece[:-1]] == [True, False, True, False, False, False, True]


def test_counts_with_a_hot_word(spark, monkeypatch):
    """A word and a pair that make up most of the corpus are dealt over all tasks."""
    monkeypatch.setattr(co, "HOT_LEAST", 10)
    rows = [("en", f"the cat w{i % 50}") for i in range(3_000)] + [("de", "the cat")] * 12
    df = co.phrase_counts(table(spark, rows))
    want = {(lang, " ".join(p)): c for (lang, p), c in counted(rows).items() if c >= 10} | {("en", ""): 9_000, ("de", ""): 24}
    assert {(r.lang, r.phrase): r.f for r in df.collect()} == want
    salts = co._hot(table(spark, rows).select("lang", "text"), 4)
    assert salts == {"en": {"the": 8, "cat": 8}}

"""op13 against plain Python, and how well the likeness estimates the Jaccard similarity."""

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from tamarisk.llm import fingerprints as fp

MASK = (1 << 64) - 1


def long_hash(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest((v & MASK).to_bytes(8, "little"), seed)
    return seed


def shingles(text):
    words = [w for w in re.split(r"[ \t-\r]+", text.lower()) if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    return {long_hash(h[i : i + 5]) for i in range(max(1, len(h) - 4))} if h else set()


def plain(text):
    """The fingerprint: probing bin by bin until a filled one is found."""
    least = {}
    for x in shingles(text):
        signed = x - (1 << 64) if x >> 63 else x
        b = (signed >> (64 - fp.BIN_BITS)) + fp.BINS // 2
        least[b] = min(least.get(b, signed), signed)
    if not least:
        return ""
    out = []
    for i in range(fp.BINS):
        j = next(j for j in [i, *((fp.STEP[i] * t + fp.START[i]) % fp.BINS for t in range(fp.BINS))] if j in least)
        out.append(f"{least[j] & 15:X}")
    return "".join(out)


def compare(p, q):
    if not p or not q:
        return float(p == q)
    return max(0.0, (sum(x == y for x, y in zip(p, q, strict=True)) / fp.BINS - 1 / 16) / (1 - 1 / 16))


def want(rows):
    """Rows (id, text) to their results, in order."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        p, e = plain(t), plain(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), p, e, round(compare(p, e), 9), round(compare(p, plain(nxt)), 9)))
    return out


def texts(seed=5):
    r = random.Random(seed)
    some = [" ".join(f"w{r.randrange(60)}" for _ in range(r.choice((0, 1, 2, 4, 5, 6, 20, 22, 60, 300, 900)))) for _ in range(60)]
    return [*some, some[3], some[3], None, "", " \t\n ", "Ünïcode Ärger über\x0bʼn 5 WORDS more", "x " * 40_000, "a\x00b c", "one"]


def check(spark, rows, parts=3):
    extra = [(i, t, "x", 1, None, True) for i, t in rows]
    docs = spark.createDataFrame(extra, "doc_id long, text string, prints string, bucket int, _bits string, guest boolean").repartition(parts)
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.edited_neighbours(docs).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=order) == sorted(want(rows), key=order)


def test_against_plain_python(spark):
    check(spark, list(enumerate(texts())))
    check(spark, [(-(7**k) if k % 2 else 7**k, t) for k, t in enumerate(texts(9)[40:58])])


def test_repeated_and_missing_ids(spark):
    rows = [(5, "the same id twice b"), (5, "the same id twice a"), (5, "the same id twice a"), (None, "no id here at all"), (None, None), (1, "first of the ids and some more words"), (9, "last " * 30)]
    check(spark, rows)
    check(spark, [(4, "alone in its table with seven words")])
    assert fp.edited_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = fp.edited_neighbours(spark.createDataFrame([(None, "abc"), (None, "xyz")], "doc_id long, text string")).collect()
    assert sorted(r.edited_sha256 for r in only) == sorted(hashlib.sha256(x.encode()).hexdigest() for x in ("abx", "xy"))


def test_one_hot_id(spark):
    """A third of the rows without an id, and a third of one id."""
    rows = [(k, f"row {k} of its own with some words") for k in range(40)] + [(7, f"copy {k} of seven") for k in range(40)] + [(None, f"no id {k}") for k in range(40)]
    check(spark, rows, 5)


def test_likeness_estimates_similarity(spark):
    r = random.Random(1)
    pairs = []
    for n in (40, 150, 400, 2000):
        for share in (0.0, 0.3, 0.6, 0.9, 1.0):
            for _ in range(12):
                a = [f"w{r.randrange(10**6)}" for _ in range(n)]
                b = a[: int(n * share)] + [f"v{r.randrange(10**6)}" for _ in range(n - int(n * share))]
                pairs.append((" ".join(a), " ".join(b)))
    df = fp.with_fingerprint(fp.with_fingerprint(spark.createDataFrame(pairs, "a string, b string"), "a", "p"), "b", "q")
    error = []
    for x in df.select("a", "b", fp.likeness(F.col("p"), F.col("q")).alias("near")).collect():
        s, t = shingles(x.a), shingles(x.b)
        error.append(x.near - len(s & t) / len(s | t))
    assert abs(sum(error) / len(error)) < 0.01 and (sum(e * e for e in error) / len(error)) ** 0.5 < 0.04


def test_fingerprints_of_a_table(spark):
    docs = spark.createDataFrame([(1, "Some words in here, five at least", "old"), (2, "some  WORDS in\there, five at least", "old"), (None, None, None)], "doc_id long, text string, fingerprint string")
    got = fp.fingerprints(docs).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [None, 1, 2] and got[0].fingerprint == "" and got[1].fingerprint == got[2].fingerprint == plain("some words in here, five at least")
    assert fp.fingerprints(docs.limit(0)).count() == 0

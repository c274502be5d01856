"""The corpus operators against plain Python, round trips and held-out accuracy, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarisk.llm import arrow, chat_format, dom, html_extract, html_pages, packing, rans, toxicity, url_filter
from tamarisk.llm.components import components
from tamarisk.llm.decontaminate import decontaminate
from tamarisk.llm.exact_dedup import exact_dedup
from tamarisk.llm.line_dedup import line_dedup
from tamarisk.llm.minhash import near_duplicates
from tamarisk.llm.shingles import shingle_sets
from tamarisk.llm.token_files import TextEncoder, read_tokens, token_digests, write_tokens

from . import brute

DDL = "doc_id long, text string, n long, key string, h string, rep long, component long, _word string"


def table(spark, docs):
    """Documents with other columns whose names the operators might use themselves."""
    return spark.createDataFrame([(i, t, 1, "k", None, 5, None, "w") for i, t in docs], DDL).repartition(3)


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=3):
    r = random.Random(seed)
    docs, base = [], [words(r, r.choice((0, 1, 3, 5, 6, 9, 30, 80, 200))) for _ in range(40)]
    for i in range(160):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 0, 1, 2, 6))):
            if w:
                w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        docs.append((i, "".join(x + r.choice((" ", " ", "  ", "\n", "\t", " \x0b")) for x in w)))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "Aaa bBb ccc"), (1004, "aaa bbb  ccc "), (1005, "é" * 12), (1006, "É" * 12), (1007, " ".join(words(r, 40_000, 20))), (1008, "a " * 30_000)]
    return docs


def test_exact(spark):
    docs = corpus()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(table(spark, docs), fan_in=2, rounds=4).collect()}
    assert got == brute.exact(docs)
    twice = exact_dedup(table(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b")])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in twice) == [("1", "1", 3, True), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 1, True)]
    assert exact_dedup(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup(table(spark, []), fan_in=3)


def test_lines(spark):
    r = random.Random(5)
    lines = [" ".join(words(r, k)) for k in (1, 2, 3, 4, 5, 8) for _ in range(5)] + ["É" * 10, "é" * 9, "short", ""]
    docs = [(i, "\n".join(r.choice(lines) + r.choice(("", " ", "\t")) for _ in range(r.randrange(9)))) for i in range(90)] + [(900, None), (901, ""), (902, "\n\n")]
    got = {x.doc_id: x["_kept"] for x in line_dedup(table(spark, docs)).collect()}
    assert got == brute.line_dedup(docs)
    kept = [x["_kept"] for x in line_dedup(table(spark, [(4, "same line here"), (4, "same line here"), (None, "same line here"), (None, None)])).orderBy(F.col("doc_id").asc_nulls_last(), "_kept").collect()]
    assert kept == ["same line here", "same line here", "", ""]
    assert line_dedup(table(spark, [])).count() == 0


def test_near(spark):
    docs = corpus() + [(2000 + i, "one phrase that many short texts hold " + " ".join(words(random.Random(i), 6))) for i in range(60)]
    docs += [(3000, docs[-1][1] + " z"), (3001, next(t for i, t in docs if i == 1007) + " end")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, docs)).collect()}
    assert got == brute.near(docs) and got[3000][1] == 2059 and got[3001][1] == 1007
    odd = near_duplicates(table(spark, [(2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in odd) == [("2", "2", True), ("2", "2", True), ("3", "3", True), ("None", "None", True)]
    assert near_duplicates(table(spark, [])).count() == 0


def test_near_group(spark):
    """One large group of near copies, many of them not linked with the least."""
    r = random.Random(8)
    base = words(r, 120, 10_000)
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(8)):
            w[r.randrange(120)] = f"y{r.randrange(10_000)}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, docs)).collect()}
    assert got == brute.near(docs)


def test_slices_change_nothing():
    docs = pa.RecordBatch.from_arrays([pa.array([t for _, t in corpus()])], ["text"])
    pieces = list(arrow.in_slices([docs], 1 << 12))
    assert len(pieces) > 5
    whole, parts = shingle_sets(docs.column(0)), [s for p in pieces for s in shingle_sets(p.column(0))]
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(99, 98)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 21 for i in range(21, 41)}, 98: 98, 99: 98}


def test_lines_odd_tables(spark, monkeypatch):
    """Frequent keys, many losing texts, clashing names, long texts and rows that repeat: as the plain version."""
    r = random.Random(9)
    lines = ["a line that most hold", "another common line", *(" ".join(words(r, 6)) for _ in range(20))]
    docs = [(i, "\n".join([lines[0], r.choice(lines), r.choice(lines)])) for i in range(120)] + [(500, "\n".join(lines * 4000)), (501, None)]
    frame = spark.createDataFrame([(i, t, "k", 1, "o") for i, t in [*docs, *docs[:20]]], "doc_id long, text string, _keep string, _n_lines int, own string").repartition(5)
    want = brute.line_dedup(docs)
    for frequent, ids in ((1_000, 2_000_000), (20, 0)):
        monkeypatch.setattr("tamarisk.llm.line_dedup.FREQUENT", frequent)
        monkeypatch.setattr("tamarisk.llm.line_dedup.BROADCAST_IDS", ids)
        monkeypatch.setattr("tamarisk.llm.line_dedup.SAMPLE", 10_000 if frequent == 20 else 200_000)
        got = line_dedup(frame)
        assert got.columns == ["doc_id", "text", "_keep", "own", "_n_lines", "_n_dropped", "_kept"]
        rows = got.collect()
        assert len(rows) == 142 and all(x["_kept"] == want[x.doc_id] and x["_n_lines"] == (x.text or "").count("\n") + 1 for x in rows)
        assert all(x["_n_dropped"] == x["_n_lines"] - (x["_kept"].count("\n") + 1 if x["_kept"] or not x["_n_dropped"] else 0) for x in rows)


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontaminate(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr("tamarisk.llm.decontaminate.BROADCAST_BYTES", 0)
    r = random.Random(4)
    items = [(i, " ".join(words(r, r.choice((0, 1, 2, 7, 9, 10, 11, 30))))) for i in range(25)] + [(90, None), (91, "same " * 14), (3, "w1 w2 w3")]
    docs = corpus(7)
    for i in range(30):
        own = (r.choice(items)[1] or "").split()
        at = r.randrange(max(1, len(own) - 8))
        docs.append((2000 + i, " ".join([*words(r, 20), *own[at : at + r.choice((8, 10, 12, 40))], *words(r, 20)]).upper().replace(" ", ", ")))
    docs.append((3000, "Same! " * 100))
    got = {x.doc_id: (x.n_words, x.n_hit, list(x["items"])) for x in decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.decontaminate(docs, items)


def test_decontaminate_without_rows(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in decontaminate(table(spark, [(1, "a b"), (None, None)]), items).orderBy("doc_id").collect()] == [(None, 0, 0), (1, 2, 0)]
    assert decontaminate(table(spark, []), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_toxicity(spark):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        w = words(r, 30) + (["idiot", "scum"] if toxic else []) + (["muslims"] if toxic or i % 5 == 0 else [])
        r.shuffle(w)
        docs.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic)))
    docs += [(9000, None), (9001, "")]
    scored = {x.doc_id: x.score for x in toxicity.toxicity(table(spark, docs), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")).collect()}
    assert len(scored) == 602 and all(0 <= s <= 1 for s in scored.values()) and scored[9000] == scored[9001] < 0.5
    assert np.mean([(scored[i] >= 0.5) == (i % 3 == 0) for i in range(600)]) > 0.97
    texts, y = [t for _, t in docs[:600]], np.array([y for _, y in labels])
    change = lambda m: abs(np.subtract(*m.score(pa.array(["many muslims live here", "many buddhists live here"]))))
    assert change(toxicity.fit(texts, y)) < 0.5 * change(toxicity.fit(texts, y, swap_weight=0.0)) or change(toxicity.fit(texts, y)) < 0.01
    none = toxicity.toxicity(table(spark, docs[:3]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [x.score for x in none] == [0.25] * 3 and not any(x.toxic for x in none)


def test_toxicity_gradient(monkeypatch):
    """The fitted weights are where the whole loss, swaps of labelled sentences included, has no slope by finite differences."""
    r = random.Random(4)
    texts = [" ".join([*words(r, 8, 30), *(["scum"] if i % 3 == 0 else ["fine"]), *(["muslims"] if i % 3 == 0 or i % 7 == 0 else [])]) + "." for i in range(150)]
    y = np.array([int(i % 3 == 0) for i in range(150)])
    before, after = map(list, zip(*toxicity._swaps(texts), strict=True))
    assert sum("w" in b for b in before) > 100  # labelled sentences, not only the carriers
    model = toxicity.fit(texts, y, steps=4000)

    def loss(w, b):
        m = toxicity.Model(model.known, w, b)
        logit = lambda t: (lambda s: np.log(s / (1 - s)))(m.score(pa.array(t, pa.large_string())))
        carriers = [c.format(t) for c in toxicity.CARRIERS for kind in toxicity.IDENTITY for t in kind]
        own = lambda z, label: np.logaddexp(0, z) - label * z
        return own(logit(texts), y).mean() + 0.05 * own(logit(carriers), 0).mean() + 0.1 / len(y) * (w**2).sum() + ((logit(before) - logit(after)) ** 2).mean()

    at = loss(model.weight, model.bias)
    for j in np.argsort(-np.abs(model.weight))[:6]:
        for step in (0.3, -0.3):
            w = model.weight.copy()
            w[j] += step
            assert loss(w, model.bias) > at - 1e-4
    swapped = toxicity.fit(texts, y, swap_weight=0.0)
    change = lambda m: np.abs(m.score(pa.array(before, pa.large_string())) - m.score(pa.array(after, pa.large_string()))).mean()
    assert change(model) < 0.2 * change(swapped)


def test_toxicity_edges(spark):
    rows = [(i, ("bad scum " if i % 2 else "good fine ") * (1 + i % 3), 0.5, True, "x") for i in range(40)] + [(7, "bad scum ", 0.5, True, "x"), (None, "good fine", None, None, None), (90, None, 0.5, False, "x"), (91, "bad scum " + "filler " * 400_000, 0.5, False, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double, Toxic boolean, _text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame, labels, columns=["doc_id", "score", "Toxic", "_text"])
    assert got.columns == ["doc_id", "_text", "score", "toxic"] and got.count() == len(rows)
    by_id = {}
    for x in got.collect():
        by_id.setdefault(x.doc_id, set()).add(round(x.score, 9))
    assert len(by_id[7]) <= 2 and max(by_id[None]) < 0.5 < min(by_id[91])
    assert toxicity.toxicity(frame.limit(0), labels).count() == 0


def test_toxicity_sample(spark):
    """Long texts are passed over, whatever their place; both classes stay in."""
    docs = [(i, "x" * (900 if i % 2 else 5)) for i in range(60)]
    labels = [(i, int(i % 10 == 0)) for i in range(60)]
    as_table = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    texts, y = toxicity.training_rows(table(spark, docs), as_table(labels), most_bytes=200)
    whole, _ = toxicity.training_rows(table(spark, docs), as_table(labels))
    assert set(map(len, texts)) == {5} and len(texts) == sum(len(t) == 5 for t in whole) > 15 and set(y) == {0, 1}
    assert len(whole) == len(toxicity.training_rows(table(spark, docs * 2), as_table(labels * 2))[0]) > 40
    rare = toxicity.training_rows(table(spark, docs), as_table([(i, int(i == 7)) for i in range(60) if i != 7] + [(8, 1)]), most=4)
    assert len(rare[0]) == 4 and set(rare[1]) == {0, 1}
    assert toxicity.sampled([(0, 20)] * 9 + [(1, 60)], 8, 100) == [0, 1, 9]


def test_toxicity_without_both_classes(spark, monkeypatch):
    """Nothing is rejected."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    for labels in ([], [(i, 1) for i in range(20)], [(i, 0) for i in range(20)]):
        monkeypatch.setattr(corpus_pipeline, "table", lambda *_, rows=labels: spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert corpus_pipeline.drop_toxic(spark, docs, "").count() == 20


def test_predicted_follows_the_score(spark, monkeypatch):
    """In the query too, labels of one class or none."""
    from tamarisk.llm import queries_toxicity

    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(40)], "doc_id long, text string")
    for labels in ([], [(i, 1) for i in range(40)], [(i, 0) for i in range(40)], [(i, i % 2) for i in range(40)]):
        tables = {"documents": docs, "labels": spark.createDataFrame(labels, "doc_id long, toxic int")}
        monkeypatch.setattr(queries_toxicity, "table", lambda _, __, name, tables=tables: tables[name])
        got = queries_toxicity.op2_toxicity(spark, "").collect()
        assert len(got) == 40 and all(x.predicted == int(x.score >= 0.5) for x in got)
        assert len({y for _, y in labels}) == 2 or not any(x.predicted for x in got)


def test_many_mentions_in_one_sentence_take_little_memory():
    import tracemalloc

    text = " ".join("muslims" if i % 4 == 0 else f"w{i % 900}" for i in range(20_000))
    tracemalloc.start()
    model = toxicity.fit([text, "scum " * 50, "fine words", "other words here"] * 3, np.array([1, 1, 0, 0] * 3), steps=20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.learnt and len(text) > 110_000 and peak < 200 << 20


def test_packing(spark):
    r = random.Random(2)
    lengths = [r.choice((0, 1, 700, 1024, 3000, r.randrange(1, 16_384))) for _ in range(500)]
    spent = lambda sizes: sum(packing.cost(c) for c in {b: c for b, _, c in packing.pack(lengths, sizes)}.values())
    assert len({c for _, _, c in packing.pack(lengths)}) >= 3
    assert spent(packing.CAPACITIES) < 0.97 * spent(packing.CAPACITIES[-1:])
    bins = {}
    for n, (own, offset, capacity) in zip(lengths, packing.pack(lengths), strict=True):
        bins.setdefault((own, capacity), []).append((offset, n))
    used = 0
    for (_, capacity), members in bins.items():
        end = 0
        for offset, n in sorted(members):
            assert offset == end
            end += n
        assert end <= capacity and capacity == min(c for c in packing.CAPACITIES if c >= end)
        used += capacity
    assert used < 1.05 * sum(lengths)
    with pytest.raises(ValueError):
        packing.pack([99_999])
    rows = packing.best_fit(table(spark, [(1, None), (2, "é" * 20_000), (3, ""), (3, "")])).collect()
    spans = sorted((x.doc_id, x.start, x.length) for x in rows)
    assert spans == [(1, 0, 1), (2, 0, 16_384), (2, 16_384, 16_384), (2, 32_768, 7_233), (3, 0, 1), (3, 0, 1)]
    assert packing.best_fit(table(spark, [])).count() == 0


def test_packing_near_optimum():
    """Small sets against the best of all ways to part them."""

    def parts(items):
        if not items:
            yield []
            return
        for rest in parts(items[1:]):
            yield [[items[0]], *rest]
            for i in range(len(rest)):
                yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]

    r, sizes, ratio = random.Random(6), (8, 16, 32), []
    for _ in range(40):
        lengths = [r.randrange(1, 25) for _ in range(7)]
        price = lambda used: min((packing.cost(c, 4, 256) for c in sizes if c >= used), default=float("inf"))
        best = min(sum(price(sum(b)) for b in p) for p in parts(lengths))
        got = sum(packing.cost(c, 4, 256) for c in {b: c for b, _, c in packing.pack(lengths, sizes, 4, 256)}.values())
        assert got >= best - 1e-9
        ratio.append(got / best)
    assert max(ratio) < 1.5 and np.mean(ratio) < 1.12


def test_packing_content(spark):
    """Texts come back whole from the tokens, and sequences from their bins."""
    docs = [(1, None), (2, "é" * 20_000), (3, ""), (4, "abc"), (4, "abc"), (None, "n"), (5, "x" * 16_383), (6, "y" * 16_384)]
    rows = packing.best_fit(table(spark, docs), content=True, columns=("doc_id", "piece", "Length")).collect()
    assert all(len(x.tokens) == x.length for x in rows)
    for i, t in docs:
        own = b"".join(x.tokens for x in sorted((x for x in rows if x.doc_id == i), key=lambda x: x.piece))
        assert own == ((t or "").encode() + packing.END) * (1 + (i == 4))
    bins = {}
    for x in rows:
        bins.setdefault((x.bin_id, x.bin_capacity), []).append((x.bin_offset, x.length))
    for (_, capacity), held in bins.items():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist() and sum(n for _, n in held) <= capacity
    plain = packing.best_fit(table(spark, docs)).collect()
    assert sorted(map(str, (x[:7] for x in plain))) == sorted(map(str, ((x.doc_id, x.piece, x.start, x.length, x.bin_id, x.bin_offset, x.bin_capacity) for x in rows)))


def test_packing_windows(monkeypatch):
    """Windows close by rows and by tokens; no row is lost."""
    monkeypatch.setattr(packing, "WINDOW", 5)
    monkeypatch.setattr(packing, "WINDOW_TOKENS", 100)
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    lengths = [3, 99, 1, 400, 2, 0, 0, 0, 0, 0, 0, 0, 50, 51]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lengths))), pa.array(lengths, pa.int64())], ["i", "_tokens"])
    out = [r for b in packing._packed((64, 128), 1, 1000, False)(iter([batch])) for r in b.to_pylist()]
    total = {}
    for x in out:
        total[x["i"]] = total.get(x["i"], 0) + x["length"]
    assert total == dict(enumerate(lengths)) and len({x["bin_id"].split("-")[1] for x in out}) >= 5


def test_urls(spark):
    rules = [("allow", "com/"), ("block", "bad.com/en/"), ("block", "net/")]
    urls = ["http://A.Bad.com/en/1?x", "https://x.com/a", "nothing", None, "http://bad.com", "http://xbad.com/en/", "http://q.net/", "ftp://z.org/a/b#c", "http://bad.com/en/2?u=://y"] + [f"http://h{i}.{t}/p{i}" for i in range(40) for t in ("com", "net")]
    got = {x.page_id: x for x in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [
        ("a.bad.com", "/en/1", "bad.com/en/"), ("x.com", "/a", "com/"), ("", "", None), ("", "", None), ("bad.com", "", None), ("xbad.com", "/en/", "com/"), ("q.net", "/", "net/"), ("z.org", "/a/b", None), ("bad.com", "/en/2", "bad.com/en/"),
    ]
    assert got[0].verdict == "block" and {x.verdict for x in got.values()} <= {"allow", "block"}
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_urls_repeated(spark):
    """A URL that repeats takes one place in the training sample, and both verdicts keep theirs."""
    rules = [("allow", "com/"), ("block", "net/")]
    hot = [f"http://hot{i}.com/" for i in range(3)]
    rest = [f"http://h{i}.{t}/p{i}" for i in range(40) for t in ("com", "net")] + [f"http://only{i}.{t}/" for i in range(30) for t in ("com", "org")]
    judged = lambda urls, n: {x.url: x.verdict for x in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, columns=("url",), train_rows=n).collect()}
    assert judged(hot * 200 + rest, 60) == judged(hot + rest, 60)
    # a hot URL that comes first by its hash, and long blocked ones
    code = lambda u: (xxhash.xxh64_intdigest(u, 42) + 2**63) % 2**64
    urls = [f"http://a{i}.com/a" for i in range(20)] + [f"http://b{i}.net/{'1' * 40}" for i in range(20)]
    first = min((f"http://hot{i}.com/a" for i in range(2000)), key=code)
    assert code(first) < min(map(code, urls))
    few = judged([first] * 200 + urls + ["http://c.org/" + "1" * 40, "http://c.org/a"], 20)
    assert few["http://c.org/" + "1" * 40] == "block" and few["http://c.org/a"] == "allow"


def test_urls_held_out(spark):
    """The trees' verdict on URLs that rules would decide, but don't here; and shares that don't know their own label."""
    r = random.Random(3)
    make = lambda bad: f"http://{'x-y-' if bad else ''}h{r.randrange(400)}.{r.choice(('biz', 'info')) if bad != (r.random() < 0.1) else 'org'}/" + ("a/" * r.randrange(3)) + (f"{r.randrange(10**9)}?u={r.randrange(99)}" if bad else "page")
    urls = [(i, make(i % 2), i % 2, i % 5 == 0) for i in range(600)]
    rules = [("block" if bad else "allow", u.split("://")[1].split("?")[0]) for _, u, bad, out in urls[:150] if not out]
    got = {x.page_id: x for x in url_filter.judge_urls(spark.createDataFrame([(i, u) for i, u, _, _ in urls], "page_id long, url string"), rules, train_rows=200).collect()}
    free = [(got[i].verdict == "block") == bool(bad) for i, _, bad, _ in urls if got[i].rule is None]
    assert len(free) > 300 and np.mean(free) > 0.95
    sample = spark.createDataFrame([(f"s{i}", f"d{i}", float(i % 2), i % 5) for i in range(40)], "suffix string, domain string, label double, fold int")
    alone = url_filter.with_shares(sample, sample, 0.25, other_folds=True).collect()
    assert {(x.suffix_share, x.domain_share) for x in alone} == {(0.25, 0.25)}
    assert {x.suffix_share for x in url_filter.with_shares(sample, sample, 0.25).collect()} == {0.5 / 3, 1.5 / 3}


def test_html():
    weights = html_extract.default_weights()
    right = 0
    for seed in range(20_000, 20_200):
        page = html_pages.labelled_page(seed)
        tree = dom.parse(page)
        label = []
        for i, mark in enumerate(tree.mark):
            label.append(int(mark) if mark else label[tree.parent[i]] if i else 0)
        right += dom.joined([c for c in tree.chunks if label[c[1]]]) == html_extract.extract([page], weights)[0]
    assert right > 180
    page = "<nav><a href=x>Home</a></nav><article><h1>T &amp; t</h1><p>One<br>two <b>three<p>Four &#233;</article><script>'<p>no</p>'</script><footer>end</footer>"
    assert html_extract.extract([page, "", "<"], weights)[:2] == ["T & t\n\nOne two three\n\nFour é", ""]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>t</title><meta charset=x><body><article><p>One</article>", "One"),
        ("<head><title>t</title><style>s</style><article><p>One</article>", "One"),
        ("<head><title>t</title>\n One", "One"),
        ("<head><title>t<body><p>One", "One"),
        ("<head><script>s</script></head><p>One", "One"),
        ("<p>One</p><![foo bar><p>Two", "One\n\nTwo"),
        ("<p>One</p><![ if x><p>Two<![endif]><p>Three", "One\n\nTwo\n\nThree"),
        ("<p>One</p><![if gte mso 9><p>Two<![endif]><p>Three", "One\n\nTwo\n\nThree"),
        ("<p>One</p><!foo><p>Two &#" + "9" * 5000 + "; on", "One\n\nTwo \ufffd on"),
        ("<p>Be <math><mi>x</mi><mspace/><msup><mn>2</mn></msup></math> so<p>Two", "Be x2 so\n\nTwo"),
        ("<p>One <object data=x><param name=y>instead</object> on<p>Two", "One instead on\n\nTwo"),
        ("<p>One <svg/> on <svg><path/><text>no</text></svg>end", "One\n\non\n\nend"),
        ("<p>One<!--><p>Two<!-- c --><p>Three", "One\n\nTwo\n\nThree"),
        ("<p>One<!---><p>Two<!----><p>Three<!-- a > b -- c --!><p>Four", "One\n\nTwo\n\nThree\n\nFour"),
        ("One<!-- open <p>Two", "One"),
        ("<p>One<!foo <p>Two<?x y?><p>Three<!bar", "OneTwo\n\nThree"),
        ("<p>One<a href='x", "One"),
        ("<p>One</p", "One"),
        ("<p>1 < 2 and <3<p>Two <a title='a>b'>link</a>", "1 < 2 and <3\n\nTwo link"),
    ],
)
def test_whole_pages(page, want):
    """All that stands in the page reaches the model."""
    assert dom.joined(dom.parse(page).chunks) == want


def test_main_text_after_odd_markup():
    article = "<article><h1>Title</h1><p>One sentence, and another. <math><mi>x</mi></math> is <object>a number</object>, of course.</p></article>"
    want = "Title\n\nOne sentence, and another. x is a number, of course."
    for page in (f"<head><title>t</title><body>{article}", f"<body><![foo>{article}"):
        assert html_extract.extract([page], html_extract.default_weights()) == [want]


LONG = "This is a full paragraph of the article, with several words and a comma in it. It has a second sentence as well."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav><h1>The title</h1>{'<p>' + '</p><p>'.join([LONG] * 6) + '</p>'}<footer>&copy; 2024 all rights reserved</footer>", ["The title", *[LONG] * 6]),
        (f"<html><body><div class=menu><a href=/>Home</a> <a href=/b>Blog</a></div><h1>The title</h1>{'<p>' + '<p>'.join([LONG] * 6)}<div class=footer>&copy; 2024</div></body></html>", ["The title", *[LONG] * 6]),
        (f"<html><body><pre>{LONG}\n\n{LONG}</pre></body></html>", [f"{LONG} {LONG}"]),
        (f"<article><header><h1>A title</h1></header><p>{LONG}</p></article>", ["A title", LONG]),
        (f"<div role=navigation><a href=/>Home</a></div><div role=main><p>{LONG}<p>{LONG}</div>", [LONG, LONG]),
        (f"<html><body>{LONG}<br><br>{LONG}</body></html>", [f"{LONG} {LONG}"]),
        (LONG, [LONG]),
        (f"<article><p>{LONG}<!--><p>{LONG}<!-- c --><p>{LONG}</article>", [LONG] * 3),
        (f"<article><h1>A title</h1><p>{'Word, ' * 2000}</p></article>", ["A title", ("Word, " * 2000).strip()]),
    ],
)
def test_pages_of_other_makes(page, want):
    """Written by hand, not by the generator: articles outside of containers lose nothing."""
    assert html_extract.extract([page], html_extract.default_weights()) == ["\n\n".join(want)]


def test_deep_pages_take_linear_time():
    import time

    took = []
    for n in (3_000, 12_000):
        page = "<p><table><tr><td>" + "<div><b>" * n + "</i></q>x<p>y" * n
        began = time.process_time()
        assert dom.joined(dom.parse(page).chunks).count("y") == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_main_text_edges(spark):
    page = "<nav><a href=x>Home</a></nav><article><h1>A title here</h1><p>One sentence, and another one.</p></article>"
    deep = "<article>" + "<div>" * 3000 + "<p>Deep sentence, and another one.</p>" + "</div>" * 3000 + "<p>After it, one more sentence.</p>" * 2000 + "</article>"
    rows = [(1, "u", page, "t", 5, None), (1, "u", page, "t", 5, None), (2, None, None, None, None, None), (3, "u", "", "t", 5, "x"), (None, "u", deep, "t", 5, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, N_chars int, _html string")
    got = html_extract.main_text(frame, columns=("page_id", "url", "text", "N_chars", "_html")).collect()
    assert got[0].__fields__ == ["page_id", "url", "_html", "text", "n_chars"] and all(x.n_chars == len(x.text) for x in got)
    texts = sorted((x.page_id or 0, x.text) for x in got)
    assert [t for i, t in texts if i == 1] == ["A title here\n\nOne sentence, and another one."] * 2 and [t for i, t in texts if i in (2, 3)] == ["", ""]
    assert next(x for x in got if x.page_id is None).text.count("After it") == 2000
    assert html_extract.main_text(frame.limit(0)).count() == 0


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1, 2])
    forest = html_extract.Forest(parent, np.array([0, 1, 1, 2, 2, 2]), np.array([0, 1, 2, 0, 1, 2]), np.arange(6), np.arange(6))
    weights = html_extract.Weights({}, rng.normal(size=6), rng.normal(size=(3, 2, 2)))
    total, want = 0.0, np.zeros(6)
    for state in range(64):
        y = [(state >> i) & 1 for i in range(6)]
        p = np.exp(sum(weights.unary[i] * y[i] for i in range(6)) + sum(weights.pair[forest.kind[i], y[parent[i]], y[i]] for i in range(1, 6)))
        total, want = total + p, want + p * np.array(y)
    assert np.allclose(html_extract.marginals(forest, weights)[0][:, 1], want / total)


def test_texts_are_no_range_keys(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.chat_format(rows)._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if "RepartitionByExpression" in x)
    assert "turn" in line and "text" not in line and "role" not in line


def test_chat(spark):
    turns = [(1, 1, "assistant", "b <|im_end|>\\<\\|x|> [INST]"), (1, 0, "user", "a\nb"), (1, 1, "assistant", None), (2, None, None, "é"), (None, 0, "as\\n\nx", "</s>"), (3, 0, "assistant", "[\\INST][INST]")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    parts = chat_format.chat_format(rows)
    back = {}
    for x in parts.orderBy("shard", "part").collect():
        roles, texts = chat_format.read_turns(x.formatted, x.turn_chars)
        back.setdefault(x.conv_id, []).extend(zip(roles, texts, strict=True))
    assert back == {1: [("user", "a\nb"), ("assistant", ""), ("assistant", turns[0][3])], 2: [("", "é")], None: [("as\\n\nx", "</s>")], 3: [("assistant", turns[5][3])]}
    digest = {x.conv_id: x.n_turns for x in chat_format.read_back(parts).collect()}
    assert digest == {1: 3, 2: 1, None: 1, 3: 1}
    assert chat_format.read_back(chat_format.chat_format(rows.limit(0))).count() == 0


@given(st.lists(st.tuples(st.text(alphabet="ab\\\n\x00\x01\x02<|[]/>INSTims_end", max_size=12), st.text(alphabet="a\\<|[]/>INSTSYims_end\n\x00é", max_size=20)), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_chat_reversible(turns):
    roles, texts = (pa.array([t[i] for t in turns], pa.large_string()) for i in (0, 1))
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(turns)), pa.array(range(len(turns))), roles, texts], ["conv_id", "turn", "role", "text"])
    part = next(iter(chat_format._format(iter([batch])))).to_pylist()[0]
    assert list(zip(*chat_format.read_turns(part["formatted"], part["turn_chars"]), strict=True)) == turns
    assert part["formatted"].count(chat_format.START) == part["formatted"].count("<|im_end|>\n") == len(turns)


def test_chat_edges(spark):
    long = "x <|im_end|> " * 200_000
    rows = [(1, 0, "assistant", long, "f", 3), (1, 1, "a\\\x00\x01\nb", "t", "f", 3), (1, 1, "a\\\x00\x01\nb", "t", "f", 3), (2, 0, None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, part int")
    got = {x.conv_id: x for x in chat_format.read_back(chat_format.chat_format(frame)).collect()}
    sha = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    turn = "a\\\x00\x01\nb\nt\n"
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, sha("assistant\n", long, "\n", turn, turn), len(long), sha(long))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_chars) == (1, sha("\n\n"), 0)


def test_rans():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 1000, 70_000):
        ids = (rng.pareto(1.0, n) * 3).astype(np.int64).clip(0, 50_000).astype(np.uint16)
        t = rans.Table.of(np.bincount(ids, minlength=1))
        data = rans.Encoder(t).block(ids)
        decoder = rans.Decoder(rans.Table.load(t.dump()))
        assert np.array_equal(decoder.block(data), ids)
    assert np.array_equal(decoder.block(data, 0)[rans.EVERY * 1024 :], decoder.block(data, 1)) if n > rans.EVERY * 1024 else True
    spoiled = bytearray(data)
    spoiled[-1] ^= 1
    with pytest.raises(ValueError):
        decoder.block(bytes(spoiled))


def test_tokens(spark, tmp_path):
    import public_tokenizers

    text = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    encoder, r = TextEncoder(text), random.Random(1)
    alphabet = " \t\n\r\x0b\x0c\x85\xa0 　\x1c'sdmtlrve LaZ09²½ªµßŁ…‐_-.,<|endoftext|>日本😀"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(3000)]
    want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == want
    docs = [(i, t) for i, t in enumerate(texts[:200])] + [(500, None), (501, ""), (None, "a b")]
    write_tokens(table(spark, docs), str(tmp_path / "t"), text)
    rows = sorted(read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in rows] == [None, *range(200), 500, 501]
    assert [x.start for x in rows] == np.cumsum([0, *(x.n_tokens for x in rows)])[:-1].tolist()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs += [(600, "long text " * 60_000), (601, "twice"), (601, "twice")]
    told = sorted(token_digests(table(spark, docs), text).collect(), key=lambda x: x.start)
    start = 0
    for x, (i, t) in zip(told, sorted(docs, key=lambda d: -1 if d[0] is None else d[0]), strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert np.frombuffer(rows[1].ids, "<u4").tolist() == [*want[0], 0] and np.frombuffer(rows[-1].ids, "<u4").tolist() == [0]
    write_tokens(table(spark, []), str(tmp_path / "e"), text)
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_tokens_added(spark, tmp_path):
    """Texts that hold an added token get the ids of a plain call, and so do their neighbours."""
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, text = Tokenizer.from_file(path), open(path, encoding="utf-8").read()
    docs = [(0, "a <|endoftext|> b"), (1, "<|endoftext|>"), (2, "x<|endoftext|><|endoftext|>\n y  z"), (3, "a <|endoftext | > b"), (4, "a b c d"), (5, "")]
    want = [plain.encode(t, add_special_tokens=False).ids for _, t in docs]
    assert want[0] == [64, 220, 50256, 275] and [x.tolist() for x in TextEncoder(text).encode(pa.array([t for _, t in docs]))] == want
    write_tokens(table(spark, docs), str(tmp_path / "t"), text)
    rows = {x.doc_id: x for x in read_tokens(spark, str(tmp_path / "t")).collect()}
    assert [np.frombuffer(rows[i].ids, "<u4").tolist() for i, _ in docs] == [[*x, 0] for x in want]
    assert [rows[i].start for i, _ in docs] == np.cumsum([0, *(len(x) + 1 for x in want)])[:-1].tolist()
    plain.add_tokens([AddedToken("d\n e"), AddedToken("q.(r")])
    texts = ["c d e f", "c d\n e f", "a q.(r b", "a qx(r b", "d e d e"]
    assert [x.tolist() for x in TextEncoder(plain.to_str()).encode(pa.array(texts))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]

"""Literal fixtures and invariants of the library's operators."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarisk.functions import models, scalars, text
from tamarisk.operators import agents, conversations, evals, inquiries
from tamarisk.operators.fuse import concatenated, reciprocal_rank_fusion
from tamarisk.operators.retrieve import Corpus, vector_top_k
from tamarisk.plans.chains import create_chain, events
from tamarisk.sources import files, versions
from tamarisk.streaming import threads


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_fusion(spark):
    lists = spark.createDataFrame([(0, 0, 1, "a"), (0, 0, 2, "b"), (0, 1, 1, "c"), (0, 1, 2, "a")], "query_id int, list_no int, rank int, doc_id string")
    got = [(r.doc_id, round(r.score, 7)) for r in reciprocal_rank_fusion(lists).orderBy("rank").collect()]
    assert got == [("a", 0.0325225), ("c", 0.0163934), ("b", 0.016129)]
    tie = spark.createDataFrame([(0, 0, 1, "b"), (0, 1, 1, "a")], "query_id int, list_no int, rank int, doc_id string")
    assert [r.doc_id for r in reciprocal_rank_fusion(tie).orderBy("rank").collect()] == ["b", "a"]


def test_scalars(spark):
    e = scalars.edit_similarity
    assert one(spark, F.round(e(F.lit("kitten"), F.lit("sitting")), 6), e(F.lit(""), F.lit("")), e(F.lit("x"), F.lit(None).cast("string")), e(F.lit("äb"), F.lit("ab"))) == (0.571429, 1.0, None, 0.5)
    assert one(spark, scalars.citation_label(F.lit("a.pdf"), F.lit(17)), scalars.citation_label(F.lit("a.pdf"), F.lit(None).cast("int"))) == ("a.pdf (p.18)", "a.pdf")
    assert one(spark, *[scalars.falsy_or(F.lit(x).cast("string"), F.lit("none")) for x in ("", None, "x")]) == ("none", "none", "x")
    assert one(spark, scalars.first_name_of_requirement(F.lit("ruff>=1,<2")), scalars.integer_or(F.lit("x"), 20), scalars.percent(F.lit(0.88)), scalars.two_decimals(F.lit(0.384))) == ("ruff", 20, "88%", "0.38")
    assert one(spark, scalars.split_list(F.lit("a, ,b ")), scalars.fill_template("{a}-{b}", a=F.lit("1"), b=F.lit("2"))) == (["a", "b"], "1-2")
    rolls = [r[0] for r in spark.range(2000).select(scalars.random_integer(0, 3, 1)).collect()]
    assert set(rolls) == {0, 1, 2, 3}
    assert one(spark, scalars.new_inquiry_id().rlike("^inq_[0-9a-f]{12}$")) == (True,)
    now = F.lit(datetime.datetime(2024, 1, 1))
    assert one(spark, scalars.display_time(now), scalars.minutes_before(now, F.lit(None).cast("int"))) == ("2024/01/01 00:00", None)


def test_fixed_chunks(spark):
    for n, chunks in ((0, 1), (1000, 1), (1001, 2), (1900, 2), (1901, 3)):
        rows = text.fixed_chunks(spark.createDataFrame([("x" * n,)], "text string")).orderBy("chunk_no").collect()
        assert len(rows) == chunks
        assert rows[0].chunk + "".join(r.chunk[100:] for r in rows[1:]) == "x" * n


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", min_size=1, max_size=400), st.integers(5, 60))
def test_recursive_chunks(source, size):
    overlap = size // 5
    chunks = text.recursive_chunks(source, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    at = 0
    for c in chunks:  # each begins inside or right after what is covered
        place = next(i for i in range(at, max(-1, at - overlap - 1), -1) if source.startswith(c, i))
        at = place + len(c)
    assert at == len(source)


def test_inquiries(spark):
    rows = spark.createDataFrame([(i, "draft", i % 3) for i in range(25)], "id long, status string, at int")
    got = inquiries.page(rows, ["id"], {"status": "draft"}, "at", "id", 20, 20).collect()
    assert len(got) == 5 and inquiries.count(rows, {"status": "all"}).first().total == 25
    assert one(spark, *[inquiries.quality_alert(F.lit(x).cast("string")) for x in (None, "OK", "NG")]) == (False, False, True)
    pairs = ((None, None), ("a", "a"), ("a", "b"), ("a", None))
    assert one(spark, *[inquiries.topic_edited(F.lit(a).cast("string"), F.lit(b).cast("string")) for a, b in pairs]) == (False, False, True, True)
    events = spark.createDataFrame(
        [("x", 1, "created", None), ("x", 2, "generated", "other"), ("x", 3, "sent", None), ("y", 1, "created", None), ("y", 2, "failed", None), ("y", 3, "retried", None), ("y", 4, "generated", "spam"), ("y", 5, "retopic", "product")],
        "id string, seq long, kind string, topic string",
    ).withColumns({c: F.lit(None).cast(t) for c, t in (("confidence", "double"), ("draft", "string"), ("final", "string"), ("edit_similarity", "double"), ("at", "timestamp"))})
    got = {r.id: (r.status, r.topic, r.original_topic) for r in inquiries.fold(events).collect()}
    assert got == {"x": ("sent", "other", "other"), "y": ("draft", "product", "spam")}
    metrics = inquiries.send_metrics(F.lit("abc"), F.lit("abd"), F.lit("a"), F.lit("a"), F.lit(""))
    assert one(spark, metrics["operator_edited_topic"], metrics["edit_similarity"]) == (False, None)
    checked = inquiries.validate(spark.createDataFrame([("a", ""), ("a", "b"), (None, "b")], "x string, y string"), ["x", "y"])
    assert [r.is_valid for r in checked.collect()] == [False, True, False]


def test_evaluation(spark):
    scores = spark.createDataFrame([("k", 1), ("k", 0), ("k", None)], "key string, score int")
    row = evals.summary(scores).first()
    assert (row.mean_score, row.n_scored) == (0.5, 2)
    judged = models.politeness_judge(F.lit(None).cast("string"))
    assert one(spark, judged["score"], models.forbidden_content_judge(F.lit("It costs $ 30"))["score"]) == (None, 0)
    with pytest.raises(ValueError):
        models.model("nothing")


def test_retrieval_by_brute_force(spark):
    docs = [(1, "a b c"), (2, "a a d"), (3, ""), (4, "e f"), (5, None)]
    queries = spark.createDataFrame([(0, ["a", "b"]), (1, ["zzz"])], "query_id int, words array<string>")
    index = Corpus(spark.createDataFrame(docs, "doc_id int, text string"), queries)
    got = {(r.query_id, r.doc_id): r.score for r in index.cosine(5).collect()}
    assert got == {(0, 1): round(2 / (3**0.5 * 2**0.5), 6), (0, 2): round(2 / (5**0.5 * 2**0.5), 6)}
    assert [r.doc_id for r in index.bm25(5).orderBy("rank").collect()] == [1, 2]
    assert create_chain("hybrid") and len(concatenated([index.cosine(1), index.bm25(1)]).collect()) == 2
    with pytest.raises(ValueError):
        create_chain("other")


def test_chain_events(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "a dog")], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "the cat?")], "query_id int, text string")
    kinds = [r.kind for r in events(create_chain("naive")(asked, docs), asked, docs).orderBy("seq").collect()]
    assert kinds[:2] == ["call", "context"] and set(kinds[2:]) == {"token"}


def test_vectors(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(300, 8)).astype("float32")
    x[7] = x[5]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in vector_top_k(rows.where("vec_id % 100 = 0 or vec_id = 5"), rows, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.doc_id
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q, found in got.items():
        order = sorted(range(300), key=lambda i: (-round(float(unit[q] @ unit[i]), 6), i))[:4]
        assert [found[k] for k in (1, 2, 3, 4)] == order


def test_conversations(spark):
    rows = spark.createDataFrame([("c", 0, "añb"), ("c", 1, "x")], "conv_id string, turn int, text string")
    back = conversations.accumulated(conversations.token_stream(rows, "conv_id", "turn"), "conv_id", "turn")
    assert {r.text for r in back.collect()} == {"añb", "x"}
    calls = spark.createDataFrame([("t", "1"), ("t", "2")], "thread_id string, tool_call_id string")
    assert [r.status for r in conversations.rejections(calls, "no").orderBy("role").collect()] == ["error", "error", None]


def test_sources(spark, tmp_path):
    (tmp_path / "e.csv").write_bytes("﻿question,context,answer\n\"a\nb\",c,d\n".encode())
    assert tuple(files.read_examples_csv(spark, str(tmp_path / "e.csv")).first()) == ("a\nb", "c", "d")
    (tmp_path / "d.yaml").write_text("dataset:\n- inputs: {customer_name: n, content: c}\n  expected_outputs: {topic: other}\n")
    row = files.flatten_examples(files.read_inquiry_examples(spark, str(tmp_path / "d.yaml"))).first()
    assert tuple(row) == ("n", None, "c", "other", None)
    (tmp_path / "t.vtt").write_text("WEBVTT\n\n00:01.500 --> 00:02.000\nhello\nyou\n\n01:00:00.000 --> 01:00:01.000\nend\n")
    assert [tuple(r) for r in files.read_cues(spark, str(tmp_path / "t.vtt")).collect()] == [(1500, 2000, "hello\nyou"), (3600000, 3601000, "end")]
    df = spark.createDataFrame([(1,)], "x int")
    store = str(tmp_path / "store")
    assert (versions.publish(df, store, "n"), versions.publish(df, store, "n"), versions.publish(df, store, "a/b c")) == (1, 2, 1)
    assert sorted((r.name, r.version) for r in versions.latest(spark, store).collect()) == [("a/b c", 1), ("n", 2)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.pdf").write_bytes(b"one|two")
    pages = files.scan_documents(spark, str(tmp_path / "p"), lambda b: b.decode().split("|")).orderBy("page").collect()
    assert [r.page_content for r in pages] == ["one", "two"]
    bodies = files.parse_bodies(spark.createDataFrame([('{"a": 1}',), ("{",)], "body string"), "a int").collect()
    assert bodies[0].request.a == 1


def test_streams(spark, tmp_path):
    rows = [("a", 1, "click"), ("a", 2, "purchase"), ("b", 1, "view"), ("b", 2, "login")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "thread_id string, seq long, event_type string").write.parquet(str(tmp_path / f"in/{i}"))
    source = lambda: spark.readStream.schema("thread_id string, seq long, event_type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {}

    def keep(batch, _):
        got.update({r.thread_id: (r.n_events, r.state) for r in batch.collect()})

    threads.thread_states(source()).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = {r.thread_id: (r.n_events, r.state) for r in threads.batch_states(spark.createDataFrame(rows, "thread_id string, seq long, event_type string")).collect()}
    assert got == want == {"a": (2, "approved"), "b": (2, "rejected")}
    spark.createDataFrame([("1", "n", "", "cheap casino"), ("2", "n", "", "a system")], "id string, customer_name string, company_name string, content string").write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("id string, customer_name string, company_name string, content string").parquet(str(tmp_path / "q"))
    threads.enrich_stream(stream, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    out = {r.id: (r.topic, r.draft is None) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {"1": ("spam", True), "2": ("development", False)}


def test_index_and_facts(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<float>")
    files.rebuild_index(rows, str(tmp_path / "i"))
    files.rebuild_index(rows, str(tmp_path / "i"))
    index = files.open_index(spark, str(tmp_path / "i"))
    assert index.count() == 2 and [r.doc_id for r in vector_top_k(index.where("vec_id = 1"), index).collect()] == [1]
    facts = spark.createDataFrame([("c", "politeness", 1.0)], "call_id string, key string, value double")
    files.append_facts(facts, str(tmp_path / "f"))
    files.append_facts(facts, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("call_id = 'c'").count() == 2


def test_decode_and_update(spark):
    raw = spark.createDataFrame([("1", '{"subject":"s","body":"b"}', "", 1, None)], "id string, ai_response string, final_response string, operator_edited_topic int, quality_alert int")
    row = inquiries.decode(raw).first()
    assert (row.ai_response.body, row.final_response, row.operator_edited_topic, row.quality_alert) == ("b", None, True, False)
    current = spark.createDataFrame([("1", "draft", "x"), ("2", "sent", "y")], "id string, status string, topic string")
    changes = spark.createDataFrame([("1", "sent", None), ("3", "draft", "z")], "id string, status string, topic string")
    assert sorted(tuple(r) for r in inquiries.apply_updates(current, changes).collect()) == [("1", "sent", "x"), ("2", "sent", "y"), ("3", "draft", "z")]
    assert inquiries.lookup(current, "id", "2").count() == 1
    inquiries.create_table(spark, "inquiries_test")
    assert "weave_call_id" in spark.table("inquiries_test").columns


def test_models_can_be_replaced():
    own = models.REGISTRY["select_route"]
    try:
        models.use("select_route", lambda question: F.lit("web"))
        assert models.model("select_route") is not own
    finally:
        models.use("select_route", own)


def test_edit_similarity_turns(spark, tmp_path):
    """Whole texts against plain dynamic programming."""
    from tamarisk.plans import text_queries

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    turns = [(1, 0, "a draft of äb " * 60), (1, 1, "the draft of äb that was sent " * 40), (1, 2, ""), (1, 3, None), (2, 0, "日本"), (2, 1, "日"), (3, 0, "alone")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): r.edit_similarity for r in text_queries.QUERIES["edit_similarity_turns"](spark, str(tmp_path)).collect()}
    text = {(c, n): t or "" for c, n, t in turns}
    assert got == {k: round(1 - distance(t, text[k[0], k[1] + 1]) / max(len(t), len(text[k[0], k[1] + 1]), 1), 6) for k, t in text.items() if (k[0], k[1] + 1) in text}


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_tables(spark, tmp_path, parts):
    """Streams read a table that is one file, and one that is a folder of part files."""
    from pathlib import Path

    from tamarisk.plans import stream_queries

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    own = tmp_path / "events.parquet"
    if parts > 1:
        events.repartition(parts).write.parquet(str(own))
    else:
        own.write_bytes(Path("/root/testdata/sf0.001/events.parquet").read_bytes())
    assert stream_queries.QUERIES["windowed_events"](spark, str(tmp_path)).agg({"n": "sum"}).first()[0] == events.count()


def test_chunk_rows_by_plain_splitter(spark):
    """Recursive chunks as a table against the rule written out plainly."""

    def pieces(t, marks):
        if len(t) <= 50:
            return [t] if t else []
        mark = next((m for m in marks if m in t), None)
        if mark is None:
            return [t[i : i + 50] for i in range(0, len(t), 50)]
        parts = t.split(mark)
        whole = [x + mark for x in parts[:-1]] + [parts[-1]]
        return [y for x in whole if x for y in pieces(x, marks[marks.index(mark) + 1 :])]

    def plain(t):
        out, held = [], []
        for p in pieces(t, ["\n\n", "\n", " "]):
            if held and len("".join(held)) + len(p) > 50:
                out.append("".join(held))
                while held and (len("".join(held)) > 10 or len("".join(held)) + len(p) > 50):
                    held = held[1:]
            held.append(p)
        return out + (["".join(held)] if held else [])

    import random

    r = random.Random(3)
    texts = ["".join(r.choice(("word ", "x", " ", "\n", "\n\n", "é" * 20)) for _ in range(r.randrange(120))) for _ in range(60)] + [None, "", "y" * 300_000]
    rows = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "id int, text string, chunk string")
    got = {}
    for x in text.recursive_chunk_rows(rows, size=50, overlap=10).orderBy("id", "chunk_no").collect():
        got.setdefault(x.id, []).append(x.chunk)
    assert got == {i: plain(t) if t else [""] for i, t in enumerate(texts)}


def test_tool_loop(spark):
    messages = spark.createDataFrame([("a", 0, "user", "go", None), ("b", 0, "user", "never", None), ("c", 0, "assistant", "said", None)], agents.MESSAGES)
    ask = lambda *names: F.array(*[F.struct(F.lit(str(i)).alias("id"), F.lit(n).alias("name"), F.lit("1").alias("args")) for i, n in enumerate(names)])

    def model(content, n):
        more = (n == 0) | (content == "again")
        return F.struct(F.when(more, "").otherwise("end").alias("content"), F.when(more & (content == "go"), ask("two", "none")).when(more, ask("again")).alias("calls"))

    done = agents.tool_loop(messages, model, {"two": lambda a: F.concat(a, F.lit("2")), "again": lambda a: F.lit("again")}, rounds=3)
    found = {}
    for x in done.orderBy("thread_id", "seq").collect():
        found.setdefault(x.thread_id, []).append((x.role, x.content))
    assert found["a"] == [("user", "go"), ("assistant", ""), ("tool", "12"), ("tool", "unknown tool: none"), ("assistant", "end")]
    assert len(found["b"]) == 1 + 2 * 3 and found["c"] == [("assistant", "said")]
    assert {x.thread_id: x.content for x in agents.final_content(done).collect()}["a"] == "end"
    assert {x.thread_id: x.status for x in agents.thread_status(done).collect()} == {"a": "done", "b": "open", "c": "done"}
    assert one(spark, *[agents.has_calls(c) for c in (F.lit(None).cast(agents.CALLS), F.array().cast(agents.CALLS), ask("x"))]) == (False, False, True)


def test_insert_and_delete(spark, tmp_path):
    path = str(tmp_path / "inquiries")
    inquiries.delete_all(spark, path)
    rows = spark.createDataFrame([("n", "e", "c")], "customer_name string, customer_email string, content string")
    inquiries.insert(rows, path)
    inquiries.insert(rows.withColumns({"status": F.lit("sent"), "classification_confidence": F.lit(1)}), path)
    got = spark.read.schema(inquiries.SCHEMA).parquet(path).orderBy("status").collect()
    assert [r.status for r in got] == ["processing", "sent"] and got[0].id != got[1].id and got[1].classification_confidence == 1.0
    assert all(r.created_at == r.updated_at and r.quality_alert is False and r.topic is None for r in got)
    inquiries.delete_all(spark, path)
    assert spark.read.schema(inquiries.SCHEMA).parquet(path).count() == 0
    assert one(spark, *[inquiries.is_confidence(F.lit(x).cast("double")) for x in (0.0, 1.0, 1.01, -0.1, None)]) == (True, True, False, False, False)


def test_updates_to_null(spark):
    current = spark.createDataFrame([("1", "draft", "x"), ("2", "sent", "y")], "id string, status string, topic string")
    changes = spark.createDataFrame([("1", "sent", None)], "id string, status string, topic string")
    assert sorted(map(tuple, inquiries.apply_updates(current, changes, sets=("topic",)).collect()), key=str) == [("1", "sent", None), ("2", "sent", "y")]


def test_jobs_and_events(spark, tmp_path):
    ddl = "id string, customer_name string, company_name string, content string"
    rows = [("1", "n", "", "cheap casino"), ("2", "n", "", "a system"), ("3", "n", "", None)]
    got = {r.id: (r.status, r.topic, r.error) for r in threads.job(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {"1": ("draft", "spam", None), "2": ("draft", "development", None), "3": ("error", None, "no content")}
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "q"))
    query = threads.enrich_stream(spark.readStream.schema(ddl).parquet(str(tmp_path / "q")), str(tmp_path / "out"), str(tmp_path / "c"), every="1 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).where("status = 'error'").count() == 1
    found = agents.staged({"one": spark.createDataFrame([(1, "a")], "id int, x string"), "two": spark.createDataFrame([(1, 2)], "id int, y int")}, "id", {"two": F.when(F.col("y") > 1, "big")})
    assert sorted(map(tuple, found.collect())) == [(1, "one", "update", '{"x":"a"}'), (1, "two", "custom", "big"), (1, "two", "update", '{"y":2}')]
    questions = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "query_id int, text string")
    answered = spark.createDataFrame([(1, "a"), (2, "other"), (3, None)], "query_id int, text string")
    assert sorted(r.query_id for r in agents.changed(questions, answered).collect()) == [2, 4]


def test_keys_and_escapes(spark):
    assert one(spark, scalars.unescaped(F.lit("caf\\u00e9")), scalars.unescaped(F.lit('a"b')), scalars.new_thread_id().rlike("^[0-9a-f]{32}$")) == ("café", 'a"b', True)
    rows = spark.createDataFrame([("a", 1), ("a", None), ("a", 1)], "x string, p int").select(scalars.document_key("x", "p").alias("k"), scalars.json_record("x", "p").alias("j")).collect()
    assert rows[0].k == rows[2].k != rows[1].k and rows[1].j == '{"x":"a","p":null}'


def test_seeds(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("- customer_name: n\n  customer_email: e\n  content: c\n  status: sent\n  minutes_ago: 5\n  ai_response: {subject: s, body: b, quality_scores: {politeness: OK}}\n")
    row = files.read_seeds(spark, str(tmp_path / "s.yaml")).first()
    assert (row.customer_name, row.minutes_ago, row.ai_response.quality_scores.politeness, row.final_response) == ("n", 5, "OK", None)


def test_retrieval_in_blocks(spark, monkeypatch):
    """Many blocks of queries, and small pieces of the corpus, give what one gives."""
    import random

    from tamarisk.operators import retrieve

    r = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(12)))) for i in range(300)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, [f"w{r.randrange(30)}" for _ in range(4)]) for i in range(20)], "query_id long, words array<string>")
    vectors = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(200)], "vec_id long, embedding array<double>")
    run = lambda: (sorted(map(tuple, Corpus(docs, asked).ranked(bm25=7, cosine=3).collect())), sorted(map(tuple, vector_top_k(vectors.where("vec_id % 10 = 0"), vectors, 4).collect())))
    whole = run()
    for name, value in (("BLOCK_TERMS", 20), ("BLOCK_BYTES", 300), ("SCORES", 50), ("SLICE", 500)):
        monkeypatch.setattr(retrieve, name, value)
    assert run() == whole and len(whole[0]) > 100
    assert Corpus(docs, asked.limit(0)).cosine(3).count() == 0


def test_entry_without_a_library():
    """Where a library of the corpus operators is missing, the other queries are still there."""
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'rrf_hybrid' in q and not any(x.startswith('op') or x == 'pipeline' for x in q); assert not set(e.oracle_sql()) - set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0

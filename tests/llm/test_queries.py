"""Every corpus query on the smallest tables, against its SQL where there is one; and the pipeline stage by stage."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tamarisk.llm import registry

from . import brute

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, tmp_path, name):
    registry.queries()[name](spark, str(DATA)).write.parquet(str(tmp_path / "out"))
    if name not in registry.oracle_sql():
        return
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    c.execute(f"CREATE TABLE want AS {registry.oracle_sql()[name]}")
    c.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    names = ", ".join(sorted(r[0] for r in c.execute("DESCRIBE want").fetchall()))
    for a, b in (("want", "got"), ("got", "want")):
        assert c.execute(f"SELECT count(*) FROM (SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b})").fetchone()[0] == 0


def test_pipeline(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(str(DATA / "benchmark.parquet")).collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, str(DATA))
        if name == "best-fit packing":
            assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == {i: len(t.encode()) + 1 for i, t in before.items()}
            break
        assert out.columns == list(corpus_pipeline.COLUMNS)
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "line dedup":
            want = brute.line_dedup(list(before.items()))
            assert after == {i: t for i, t in want.items() if t.strip(brute.SPACE) or t == before[i]}
        elif name == "MinHash near-dedup":
            assert set(after) == {i for i, (_, c) in brute.near(list(before.items())).items() if i == c}
        elif name == "benchmark decontamination":
            assert set(after) == {i for i, x in brute.decontaminate(list(before.items()), items).items() if not x[1]}
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_stages_at_the_edges(spark, monkeypatch):
    """Nulls in every column, empty and long texts, repeated rows, clashing names and empty tables, stage by stage."""
    item = "one two three four five six seven eight nine ten"
    rows = [(1, "a text of its own", "en", "s", 17), (1, "a text of its own", "en", "s", 17), (2, None, None, None, None), (3, "", "en", "s", 0), (None, f"it holds {item} inside", None, None, None), (4, "long words " * 50_000, "en", "s", 550_000), (5, f"{item}", "en", "s", 48), (6, "the same long line\nand 6", "en", "s", 24), (7, "the same long line", "en", "s", 18)]
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, tokens string, kept boolean")
    tables = {"labels": spark.createDataFrame([], "doc_id long, toxic int"), "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string")}
    monkeypatch.setattr(corpus_pipeline, "table", lambda _, __, name: tables[name])
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert stage(spark, docs.limit(0), "").count() == 0
        ids[name] = sorted(str(r.doc_id) for r in out.collect())
    every = sorted(str(r[0]) for r in rows)
    assert ids["toxicity"] == every
    assert ids["line dedup"] == [x for x in every if x != "7"]
    assert ids["best-fit packing"] == sorted([*every, *["4"] * (-(-(len(rows[5][1]) + 1) // 16_384) - 1)])
    assert ids["MinHash near-dedup"] == every
    assert ids["benchmark decontamination"] == [x for x in every if x not in ("5", "None")]

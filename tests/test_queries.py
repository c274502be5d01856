"""Every query of the library against its SQL on DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tamarisk.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, tmp_path, name):
    registry.QUERIES[name](spark, str(DATA)).write.parquet(str(tmp_path / "out"))
    if name not in registry.SQL:
        return
    duck.execute(f"CREATE OR REPLACE TEMP TABLE want AS {registry.SQL[name]}")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = sorted(r[0] for r in duck.execute("DESCRIBE want").fetchall())
    assert columns == sorted(r[0] for r in duck.execute("DESCRIBE got").fetchall())
    names = ", ".join(columns)
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.execute(f"SELECT count(*) FROM (SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b})").fetchone()[0] == 0

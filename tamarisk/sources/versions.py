"""Versions of named datasets: manifests, reads as of a version, and differences by trees of hashes.

The rows of a version lie in buckets by a hash of the row, and every bucket has a digest that does not depend on the order of
its rows. A version is a manifest: which folder holds each bucket, and a tree of digests over the buckets. It is written only if
its number is not there yet, so of two publishers at once one starts again with the next number. A bucket that is as it was
in the version before is not written again. Two versions are compared from the roots of their trees down, so only buckets
that differ are read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators.keyed_table import names_in, read_text, write_once
from tamarisk.sources.tables import work_dir

#: Children of a node of the tree, and buckets of a version.
FAN_OUT, BUCKETS = 8, 64
TRIES = 20


def _home(path: str, name: str) -> str:
    return f"{path}/name={quote(name, safe='')}"


def names(spark: SparkSession, path: str) -> list[str]:
    return sorted(unquote(n.removeprefix("name=")) for n in names_in(spark, path) if n.startswith("name="))


def numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Versions of a dataset, from a listing of its manifests."""
    return sorted(int(n.removesuffix(".json")) for n in names_in(spark, f"{_home(path, name)}/versions") if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, name: str, version: int | None = None) -> dict:
    """The manifest of a version, of the last one unless given."""
    found = numbers(spark, path, name)
    if version is None and found:
        version = found[-1]
    if version not in found:
        raise ValueError(f"no version {version} of {name}")
    return json.loads(read_text(spark, f"{_home(path, name)}/versions/{version:010d}.json"))


def tree(leaves: list[str]) -> list[list[str]]:
    """Levels of digests, the leaves first and the root last."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashlib.sha256(",".join(below[i : i + FAN_OUT]).encode()).hexdigest()[:32] for i in range(0, len(below), FAN_OUT)])
    return levels


def differing(a: list[list[str]], b: list[list[str]]) -> list[int]:
    """The leaves in which two trees of the same shape differ, looking only below nodes that differ."""
    nodes = [0] if a[-1] != b[-1] else []
    for x, y in zip(a[-2::-1], b[-2::-1], strict=True):
        nodes = [c for n in nodes for c in range(n * FAN_OUT, min((n + 1) * FAN_OUT, len(x))) if x[c] != y[c]]
    return nodes


def publish(df: DataFrame, path: str, name: str) -> int:
    """Write df as the next version of a named dataset; gives its number. Rows that repeat stay; columns may have any type that
    can be hashed, and differ from those of earlier versions."""
    spark, home = df.sparkSession, _home(path, name)
    columns = df.columns
    placed = df.withColumn("_bucket", F.pmod(F.xxhash64(*columns) if columns else F.lit(0), F.lit(BUCKETS)).cast("int"))
    staged = f"{work_dir(spark, 'version')}/rows"
    placed.write.parquet(staged)
    rows = spark.read.schema(placed.schema).parquet(staged)
    both = (F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns))
    digests = rows.groupBy("_bucket").agg(F.count("*").alias("n"), *[F.sum(h.cast("decimal(38,0)")).alias(f"s{i}") for i, h in enumerate(both)]).collect()  # BUCKETS rows
    kind = df.schema.simpleString()
    leaves = {r["_bucket"]: hashlib.sha256(f"{kind},{r.n},{r.s0},{r.s1}".encode()).hexdigest()[:32] for r in digests}
    for _ in range(TRIES):
        found = numbers(spark, path, name)
        before = manifest(spark, path, name, found[-1]) if found else {"tree": [[""] * BUCKETS], "folders": {}}
        fresh = [b for b, d in leaves.items() if before["tree"][0][b] != d]
        folder = uuid.uuid4().hex
        if fresh:
            # a bucket whose rows are all equal is dealt over several tasks like any other
            part = rows.where(F.col("_bucket").isin(fresh)).repartition("_bucket", F.pmod(F.monotonically_increasing_id(), F.lit(8)))
            part.write.partitionBy("_bucket").parquet(f"{home}/rows/{folder}")
        folders = {str(b): (folder if b in set(fresh) else before["folders"][str(b)]) for b in leaves}
        version = (found[-1] if found else 0) + 1
        text = json.dumps({"version": version, "schema": df.schema.jsonValue(), "rows": sum(r.n for r in digests), "tree": tree([leaves.get(b, "") for b in range(BUCKETS)]), "folders": folders})
        if write_once(spark, f"{home}/versions/{version:010d}.json", text):
            return version
    raise RuntimeError("other publishers were always faster")


def _rows(spark: SparkSession, path: str, name: str, m: dict, buckets: list[int] | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(m["schema"])
    paths = [f"{_home(path, name)}/rows/{f}/_bucket={b}" for b, f in m["folders"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """The rows of a version, of the last one unless given."""
    return _rows(spark, path, name, manifest(spark, path, name, version))


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the last version of every dataset below path, with name and version; columns that one lacks are null."""
    out: DataFrame | None = None
    for name in names(spark, path):
        if numbers(spark, path, name):
            m = manifest(spark, path, name)
            rows = _rows(spark, path, name, m).withColumns({"name": F.lit(name), "version": F.lit(m["version"])})
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no dataset below {path}")
    return out


def difference(spark: SparkSession, path: str, name: str, old: int, new: int) -> tuple[DataFrame, list[int]]:
    """Rows that new has more of than old (change: added) or fewer (removed), as often as that; and the buckets that were read.
    Both versions have the same columns."""
    a, b = (manifest(spark, path, name, v) for v in (old, new))
    if a["schema"] != b["schema"]:
        raise ValueError("the versions have other columns")
    buckets = differing(a["tree"], b["tree"])
    counted = lambda m, n: _rows(spark, path, name, m, buckets).select("*", F.lit(n).alias("_n"))
    both = counted(a, -1).unionByName(counted(b, 1))
    columns = [c for c in both.columns if c != "_n"]
    net = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    times = F.array_repeat(F.when(F.col("_n") > 0, "added").otherwise("removed"), F.abs("_n").cast("int"))
    return net.select(*columns, F.explode(times).alias("change")), buckets

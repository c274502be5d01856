"""A keyed table that is changed in place: base files and deltas by hash bucket, merged when read, compacted bucket by bucket.

Each column merges by a rule that does not depend on the order in which changes come, nor on how often: `last` keeps the
value of the greatest stamp, `min` and `max` the least and the greatest value. So batches may arrive late, twice or at once.

A change is written as a delta, one row for each key in it. What is valid is said by a manifest: a small text file with a
number, written only if that number is not there yet, so of two writers at once one starts again from the other's result. A
reader merges the buckets that have deltas and passes the others on as they are, without a shuffle. Compaction rewrites the
base of touched buckets alone; no file of another bucket is read or written, and older manifests go on to be readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: How often a writer starts again when others were faster.
TRIES = 20


def stamped(value: Column, at: Column) -> Column:
    """A change to a `last` column: the value (null too) as of a stamp; without a stamp no change."""
    return F.when(at.isNotNull(), F.struct(at.cast("long").alias("at"), value.alias("v")))


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it is there; whether it was written."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # whole or absent: written aside, then renamed, which fails where the target is
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    system.mkdirs(where.getParent())
    out = system.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        done = False if system.exists(where) else bool(system.rename(aside, where))
    finally:
        system.delete(aside, False)
    return done


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder; nothing if it is not there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())


class KeyedTable:
    """A table of rows (key, columns). columns are stored as they merge: `last` as struct<at:long,v:T>, the others plain."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, merges: dict[str, str], buckets: int = 32) -> None:
        self.spark, self.path, self.key, self.merges, self.buckets = spark, path, key, merges, buckets
        plain: StructType = _parse_datatype_string(schema)
        kinds = {f.name: f.dataType.simpleString() for f in plain}
        self.schema = ", ".join(f"`{c}` {f'struct<at:bigint,v:{kinds[c]}>' if merges.get(c) == 'last' else kinds[c]}" for c in kinds)
        self.columns = [c for c in kinds if c != key]

    # what is valid

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.path}/manifest") if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        """base: the folder of each bucket that has one; deltas: folders of changes since, with the buckets that they touch."""
        found = self.numbers()
        if number is None and not found:
            return {"number": -1, "base": {}, "deltas": {}}
        return json.loads(read_text(self.spark, f"{self.path}/manifest/{(found[-1] if number is None else number):010d}.json"))

    def _commit(self, change) -> dict:
        """Write the next manifest as change makes it of the last one; change gives None if there is nothing to do."""
        for _ in range(TRIES):
            before = self.manifest()
            after = change(json.loads(json.dumps(before)))
            if after is None:
                return before
            after["number"] = before["number"] + 1
            if write_once(self.spark, f"{self.path}/manifest/{after['number']:010d}.json", json.dumps(after)):
                return after
        raise RuntimeError("other writers were always faster")

    # changes

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row for each key. A `last` column keeps the greatest stamp, of equal ones the greatest value."""
        rule = {"last": F.max, "min": F.min, "max": F.max}
        return rows.groupBy(self.key).agg(*[rule[self.merges[c]](c).alias(c) for c in self.columns])

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def upsert(self, changes: DataFrame) -> dict:
        """Merge rows (key and some of the columns, as they are stored; null means no change) into the table. Rows without a
        key are left out. Gives the manifest."""
        kinds = _parse_datatype_string(self.schema)
        have = set(changes.columns)
        rows = changes.where(F.col(self.key).isNotNull()).select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])
        name = uuid.uuid4().hex
        self._placed(self._merged(rows)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/delta/{name}")
        touched = sorted(int(n.split("=")[1]) for n in names_in(self.spark, f"{self.path}/delta/{name}") if n.startswith("bucket="))

        def add(m: dict) -> dict | None:
            m["deltas"][name] = touched
            return m if touched else None

        return self._commit(add)

    def compact(self, least: int = 1) -> list[int]:
        """Rewrite the buckets that have at least so many deltas: base and deltas become the base. Gives their numbers."""
        m = self.manifest()
        of = [b for b in range(self.buckets) if sum(b in touched for touched in m["deltas"].values()) >= least]
        if not of:
            return []
        name = uuid.uuid4().hex
        merged = self._merged(self._stored(m, of, with_base=True).drop("bucket"))
        self._placed(merged).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/base/{name}")

        def replace(now: dict) -> dict | None:
            if any(now["base"].get(str(b)) != m["base"].get(str(b)) for b in of):
                return None  # another compaction was there first; nothing is lost
            for b in of:
                now["base"][str(b)] = name
            for delta, touched in list(now["deltas"].items()):
                if delta in m["deltas"]:
                    now["deltas"][delta] = [b for b in touched if b not in of]
                    if not now["deltas"][delta]:
                        del now["deltas"][delta]
            return now

        return of if self._commit(replace)["base"].get(str(of[0])) == name else []

    # reading

    def _stored(self, m: dict, buckets: list[int], with_base: bool) -> DataFrame:
        """Rows as stored of these buckets, from base and deltas."""
        wanted = set(buckets)
        paths = [f"{self.path}/delta/{name}/bucket={b}" for name, touched in m["deltas"].items() for b in touched if b in wanted]
        paths += [f"{self.path}/base/{name}/bucket={b}" for b, name in m["base"].items() if int(b) in wanted] if with_base else []
        return self._read(paths)

    def _read(self, paths: list[str]) -> DataFrame:
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        paths = [p for p in paths if there(p).getFileSystem(hadoop).exists(there(p))]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, number: int | None = None, keys: list | None = None) -> DataFrame:
        """The rows as of a manifest (the last one unless given); with keys only theirs, from their buckets."""
        m = self.manifest(number)
        buckets = list(range(self.buckets))
        if keys is not None:
            kind = _parse_datatype_string(self.schema)[self.key].dataType
            asked = self.spark.createDataFrame([(k,) for k in keys], StructType().add(self.key, kind))
            buckets = [r.bucket for r in self._placed(asked).select("bucket").distinct().collect()]
        changed = sorted({b for touched in m["deltas"].values() for b in touched} & set(buckets))
        same = self._read([f"{self.path}/base/{name}/bucket={b}" for b, name in m["base"].items() if int(b) in set(buckets) - set(changed)])
        rows = self._merged(self._stored(m, changed, with_base=True)).unionByName(same) if changed else same
        rows = rows if keys is None else rows.where(F.col(self.key).isin(keys))
        return rows.select(self.key, *[(F.col(c)["v"] if self.merges[c] == "last" else F.col(c)).alias(c) for c in self.columns])

"""Stored postings: a lexical index that answers without reading a text.

Documents are taken in ranges of at most RANGE. A row of the index is a block: the documents of one range that hold one term,
how often each holds it, and the greatest frequency and the least length among them. Blocks lie in buckets by a hash of the
term, so a query reads the buckets of its own terms alone. Statistics are not stored but added up from the blocks, so a segment
of further documents can be appended at any time, and what was written before stays as it is.

A search is block-max pruned. What frequency and length allow at most bounds the score of every document of a range: first the
ranges of the highest bounds are scored, which gives each query a k-th best score; then a range is scored for those queries only
whose k-th best score its bound reaches, and only blocks with a term of such a query are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators.retrieve import BLOCK_TERMS, DIGITS, K1, SCORES, B, Best, best, query_terms, rounded
from tamarisk.sources.tables import work_dir

#: Documents, and bytes of text, of a range.
RANGE, RANGE_BYTES = 64, 16 << 20
BUCKETS = 64
#: One range in so many, but at least one, is scored first.
SEEDS = 16
BLOCKS = "segment int, bucket int, range long, term string, docs array<int>, tf array<int>, n long, most int, shortest int"
RANGES = "segment int, range long, ids array<long>, lengths array<int>, n long, words long"


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _inverted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of each range of at most so many documents one row without a term (ids and lengths), and one for each term."""
    names = ["range", "term", "docs", "tf", "n", "most", "shortest", "ids", "lengths"]
    base, number = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, most)
            while part.num_rows > 1 and part.nbytes > RANGE_BYTES:
                part = part.slice(0, part.num_rows // 2)
            at += part.num_rows
            n = part.num_rows
            texts = part.column(1).take(pa.array(range(n), pa.int64())).cast(pa.large_string())
            lists = pc.split_pattern(texts, " ")
            coded = lists.flatten().dictionary_encode()
            vocabulary, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            blank = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
            keys, tf = np.unique((code * n + row)[code != blank], return_counts=True)
            code, row = keys // n, keys % n
            length = np.bincount(row, tf, n).astype(np.int32)
            begin = np.flatnonzero(np.diff(code, prepend=-1))
            terms = vocabulary.take(pa.array(code[begin])).cast(pa.string())
            offsets = pa.array(np.append(begin, len(code)), pa.int32())
            tf = tf.astype(np.int32)
            blocks = [pa.array(np.full(len(begin), base + number)), terms, pa.ListArray.from_arrays(offsets, pa.array(row.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf)), pa.array(np.diff(np.append(begin, len(code))))]
            blocks += [pa.array(f.reduceat(x, begin) if len(begin) else np.zeros(0, np.int32)) for f, x in ((np.maximum, tf), (np.minimum, length[row]))]
            blocks += [pa.nulls(len(begin), pa.list_(pa.int64())), pa.nulls(len(begin), pa.list_(pa.int32()))]
            if len(begin):
                yield pa.RecordBatch.from_arrays(blocks, names)
            whole = [pa.array([base + number]), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), pa.array([n]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([length.tolist()], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(whole, names)
            number += 1


def append(docs: DataFrame, path: str) -> int:
    """Index documents (doc_id, text) as the next segment; gives its number. Null texts have no words. Ids are whole numbers, and
    a document is indexed in one segment only. A segment that is there already is an error, so of two writers one fails."""
    spark = docs.sparkSession
    segment = max(segments(spark, path), default=-1) + 1
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"(?U)\s+", " ").alias("text"))
    staged = f"{work_dir(spark, 'postings')}/inverted"
    kind = "range long, term string, docs array<int>, tf array<int>, n long, most int, shortest int, ids array<long>, lengths array<int>"
    most = RANGE
    own.mapInArrow(lambda batches: _inverted(batches, most), kind).write.parquet(staged)
    rows = spark.read.schema(kind).parquet(staged)
    described = rows.where("term IS NULL").select("range", "ids", "lengths", "n", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("words"))
    blocks = rows.where("term IS NOT NULL").withColumn("bucket", _bucket("term")).drop("ids", "lengths")
    # terms of a bucket side by side; a bucket's ranges are dealt over tasks, so no term is too many for one
    dealt = blocks.repartition("bucket", F.pmod("range", F.lit(8))).sortWithinPartitions("bucket", "term", "range")
    dealt.write.mode("error").partitionBy("bucket").parquet(f"{path}/blocks/segment={segment}")
    described.write.mode("error").parquet(f"{path}/ranges/segment={segment}")
    return segment


def segments(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole segments, from a listing of folders."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/ranges")
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    names = [s.getPath() for s in system.listStatus(where)]
    ready = [p.getName() for p in names if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in ready if n.startswith("segment="))


class _Asked:
    """Some of the queries: their terms in order, and the queries of each."""

    def __init__(self, rows: list) -> None:
        self.queries = sorted({r.query_id for r in rows})
        number = {q: i for i, q in enumerate(self.queries)}
        self.terms = sorted({r.term for r in rows})
        place = {t: i for i, t in enumerate(self.terms)}
        at = np.array([place[r.term] for r in rows], np.int64)
        order = np.argsort(at, kind="stable")
        self.query = np.array([number[r.query_id] for r in rows], np.int64)[order]
        self.bounds = np.searchsorted(at[order], np.arange(len(self.terms) + 1))
        self.idf, self.mean = np.zeros(len(self.terms)), 1.0

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each given term once for each query that asks it: place among the given ones, and query."""
        many = self.bounds[term + 1] - self.bounds[term]
        return np.repeat(np.arange(len(term)), many), self.query[np.repeat(self.bounds[term] - np.cumsum(many) + many, many) + np.arange(many.sum())]

    def weight(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def limits(self, term: np.ndarray, most: np.ndarray, shortest: np.ndarray) -> np.ndarray:
        """Of one range the score of each query that no document exceeds."""
        at, query = self.spread(term)
        return np.bincount(query, self.weight(term, most, shortest)[at], len(self.queries))


class Postings:
    """The index as of all whole segments. read has, after a search, of each block of queries the index blocks with its terms and
    those whose documents were read, and the pairs of a query and a range with its terms and those that were scored."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, found = spark, segments(spark, path)
        paths = lambda kind: [f"{path}/{kind}/segment={s}" for s in found]
        of = lambda kind, schema: spark.read.option("basePath", f"{path}/{kind}").schema(schema).parquet(*paths(kind)) if found else spark.createDataFrame([], schema)
        self.blocks, self.ranges = of("blocks", BLOCKS), of("ranges", RANGES)
        self.read: list[dict[str, int]] = []

    def bm25(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """query_id, doc_id, score, rank of queries (query_id, words): the rows of a scan of all texts. Scores are rounded before
        they rank; ties by document. Queries go to every task in blocks of at most BLOCK_TERMS terms."""
        terms = query_terms(queries)
        n = max(1, -(-terms.count() // BLOCK_TERMS))
        folder, self.read = work_dir(self.spark, "found"), []
        kind = terms.schema["query_id"].dataType.simpleString()
        schema = f"query_id {kind}, doc_id long, score double"
        self.spark.createDataFrame([], schema).write.parquet(f"{folder}/none")
        size = self.ranges.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        for i in range(n):
            if size.n and (rows := terms.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).collect()):
                self._search(_Asked(rows), size, k, f"{folder}/{i}-", schema)
        return best(self.spark.read.schema(schema).parquet(f"{folder}/*"), k)

    def _search(self, asked: _Asked, size, k: int, folder: str, schema: str) -> None:
        spark = self.spark
        terms = spark.createDataFrame(list(enumerate(asked.terms)), "t int, term string").withColumn("bucket", _bucket("term"))
        buckets = [r.bucket for r in terms.select("bucket").distinct().collect()]  # at most BUCKETS
        own = self.blocks.where(F.col("bucket").isin(buckets)).join(F.broadcast(terms), ["bucket", "term"])
        seen = np.zeros(len(asked.terms))
        for r in own.groupBy("t").agg(F.sum("n").alias("n")).collect():
            seen[r.t] = r.n
        asked.mean = size.words / size.n if size.words else 1.0
        asked.idf = np.log(1 + (size.n - seen + 0.5) / (seen + 0.5))
        shared = spark.sparkContext.broadcast(asked)
        staged = work_dir(spark, "ranges")

        def stored(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{staged}/{name}")
            return spark.read.schema(df.schema).parquet(f"{staged}/{name}")

        def chosen(floor: np.ndarray, name: str) -> DataFrame:
            """Blocks that may serve a query, by their range's promise, which is known without the documents."""
            described = own.select("segment", "range", "t", "most", "shortest").groupBy("segment", "range")
            return stored(described.applyInArrow(_promised(shared, spark.sparkContext.broadcast(floor)), "segment int, range long, t int, promise double, n_queries long"), name)

        def scored(wanted: DataFrame, floor: np.ndarray, name: str) -> None:
            key = ["segment", "range"]
            left = self.ranges.join(wanted.select(*key).distinct(), key, "left_semi").select("segment", "range", "ids", "lengths").groupBy(*key)
            right = own.join(wanted.select(*key, "t"), [*key, "t"], "left_semi").select("segment", "range", "t", "docs", "tf", "most", "shortest").groupBy(*key)
            left.cogroup(right).applyInArrow(_best_of_range(shared, spark.sparkContext.broadcast(floor), k, schema), schema).write.parquet(f"{folder}{name}")

        nothing = np.full(len(asked.queries), -np.inf)
        every = chosen(nothing, "every")
        ranges = every.groupBy("segment", "range").agg(F.first("promise").alias("promise"))
        seeds = stored(ranges.orderBy(F.desc("promise"), "segment", "range").limit(max(1, ranges.count() // SEEDS)).select("segment", "range"), "seeds")
        first = stored(every.join(seeds, ["segment", "range"], "left_semi"), "first")
        scored(first, nothing, "first")
        floor, place = nothing.copy(), {q: i for i, q in enumerate(asked.queries)}
        for r in best(spark.read.schema(schema).parquet(f"{folder}first"), k).where(F.col("rank") == k).collect():  # a row a query
            floor[place[r.query_id]] = r.score
        rest = stored(chosen(floor, "served").join(seeds, ["segment", "range"], "left_anti"), "rest")
        scored(rest, floor, "rest")
        sizes = [df.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n_queries"), F.lit(0)).alias("pairs")).first() for df in (first, rest, every)]
        self.read.append({f"{of}{c}": n for c in ("blocks", "pairs") for of, n in (("", sizes[0][c] + sizes[1][c]), ("of_", sizes[2][c]))})


def _promised(asked, floor):
    """Of a range what it promises those queries that it may still serve, and the blocks with their terms."""

    def run(t: pa.Table) -> pa.Table:
        own, term = asked.value, t["t"].to_numpy()
        limits = own.limits(term, t["most"].to_numpy(), t["shortest"].to_numpy())
        use = (limits > 0) & (limits + 10.0**-DIGITS >= floor.value)
        at, query = own.spread(term)
        kept = t.take(pa.array(np.unique(at[use[query]])))
        n = kept.num_rows
        return pa.table({"segment": kept["segment"], "range": kept["range"], "t": kept["t"], "promise": pa.array(np.full(n, limits[use].sum())), "n_queries": pa.array([int(use.sum()), *[0] * n][:n], pa.int64())})

    return run


def _best_of_range(asked, floor, k: int, schema: str):
    """Of a range the k best documents of each query that it may serve."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, least = asked.value, floor.value
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], kind), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, lengths = left["ids"][0].values, left["lengths"][0].values.to_numpy()
        term = right["t"].to_numpy()
        use = own.limits(term, right["most"].to_numpy(), right["shortest"].to_numpy()) + 10.0**-DIGITS >= least
        width, narrow = int(use.sum()), np.cumsum(use) - 1
        docs, tf = (right[c].combine_chunks().flatten().to_numpy() for c in ("docs", "tf"))
        of = np.repeat(term, np.diff(right["docs"].combine_chunks().offsets.to_numpy()))
        weight = own.weight(of, tf, lengths[docs])
        sums = np.zeros(len(lengths) * width)
        reach = np.cumsum(own.bounds[of + 1] - own.bounds[of]) // SCORES
        cuts = [0, *(np.flatnonzero(np.diff(reach)) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            at, query = own.spread(of[a:b])
            kept = use[query]
            at, query = at[kept] + a, narrow[query[kept]]
            sums += np.bincount(docs[at].astype(np.int64) * width + query, weight[at], len(sums))
        score = rounded(sums).reshape(len(lengths), width)
        numbers = np.flatnonzero(use)
        row, query = np.nonzero((sums.reshape(len(lengths), width) > 0) & (score >= least[numbers]))
        held = Best(k, len(own.queries), pa.int64())
        held.add(numbers[query], ids.take(pa.array(row)), np.column_stack([score[row, query]] * 3))
        held.merge()
        return pa.table({"query_id": pa.array([own.queries[q] for q in held.query.tolist()], kind), "doc_id": held.ids, "score": pa.array(held.values[:, 0])})

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(schema)["query_id"].dataType)
    return run

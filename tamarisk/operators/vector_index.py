"""A stored vector index: an inverted file of k-means cells, searched exactly.

Rows lie in a folder for each cell, ordered by their distance from its centre. A table of cells has the centre, the least and
the greatest distance (the cell's shell) and the number of rows of each. By the triangle inequality no row of a cell is nearer
to a query than the distance of query and centre allows. A query probes the cells in order of that bound, a few at first and
four times as many in each further round, until the bound of the next cell is beyond the k-th best row so far. So the result is
that of a scan, and only the folders of probed cells are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators.retrieve import BLOCK_BYTES, DIGITS, Best, best
from tamarisk.sources.tables import work_dir

#: Centres are fitted to at most so many rows, chosen by a hash; every row is indexed.
TRAIN_ROWS = 100_000
#: At most so many cells, about the square root of the number of rows.
MOST_CELLS = 4096
#: A cell of more rows is dealt over several files.
FILE_ROWS = 250_000
#: Cells that a query probes in the first round.
FIRST = 4
#: Numbers of distances between queries and cells that are held at a time, by the driver and by a task.
DISTANCES, TASK_DISTANCES = 1 << 23, 1 << 20
#: What rounding may take off a bound.
SLACK = 1e-6


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors; a zero vector stays one."""
    x = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T, 0))


def _placed(centres):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _units(batch.column(1))
                step = max(1, TASK_DISTANCES // len(centres.value))
                cell, distance = np.zeros(len(x), np.int32), np.zeros(len(x))
                for at in range(0, len(x), step):
                    d = _distances(x[at : at + step], centres.value)
                    cell[at : at + step], distance[at : at + step] = d.argmin(1), d.min(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(cell), pa.array(distance)], ["id", "v", "cell", "distance"])

    return run


def _sample(rows: DataFrame, n: int) -> DataFrame:
    """At most TRAIN_ROWS of n rows (id, v), dealt over the tasks; where all rows are alike there may be none."""
    if n > TRAIN_ROWS:
        # a share somewhat below TRAIN_ROWS / n, so that chance does not bring more; no sort, which would end in one task
        share = max(1.0, TRAIN_ROWS - 8 * TRAIN_ROWS**0.5) / n
        rows = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40)) < int(share * (1 << 40)))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def build(rows: DataFrame, path: str, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> None:
    """Write the index of all rows that have a vector to a new folder. Vectors are stored at unit length; rows that repeat an
    id are all indexed. Without rows there is an index without cells."""
    spark, folder = rows.sparkSession, work_dir(rows.sparkSession, "vectors")
    # vectors may be costly to make, and are read three times
    rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL").write.parquet(f"{folder}/own")
    own = spark.read.schema("id long, v array<double>").parquet(f"{folder}/own")
    n = own.count()
    if n:
        sample = _sample(own, n)
        sample = sample if sample.take(1) else own.limit(1)
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        units = sample.select(array_to_vector(F.transform("v", lambda x: x / F.greatest(length, F.lit(1e-300)))).alias("features"))
        apart = units.distinct().limit(2).collect()  # k-means fails on rows that are all alike
        wanted = max(1, min(cells or int(n**0.5), MOST_CELLS, n))
        centres = np.array(KMeans(k=wanted, maxIter=10, seed=1).fit(units).clusterCenters()) if len(apart) > 1 else np.array([apart[0].features.toArray()])
    else:
        centres = np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centres)
    # which file a row goes to depends on how many rows its cell has
    staged = f"{folder}/placed"
    own.mapInArrow(_placed(shared), "id long, v array<double>, cell int, distance double").write.parquet(staged)
    placed = spark.read.schema("id long, v array<double>, cell int, distance double").parquet(staged)
    found = placed.groupBy("cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n")).collect()
    table = [(r.cell, centres[r.cell].tolist(), r.low, r.high, r.n) for r in found]
    described = spark.createDataFrame(table, "cell int, centre array<double>, low double, high double, n long")
    described.coalesce(1).write.parquet(f"{path}/cells")
    files = F.broadcast(described.select("cell", F.ceil(F.col("n") / FILE_ROWS).alias("files")))
    dealt = placed.join(files, "cell").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))
    dealt.repartition("cell", "file").sortWithinPartitions("cell", "distance").select("id", "v", "distance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")


class VectorIndex:
    """An index that was built. read has, after a search, the cells, their rows and the rounds that each block of queries took."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        self.cells = np.array([r.cell for r in cells], np.int64)
        self.centres = np.array([r.centre for r in cells]) if cells else np.zeros((0, 1))
        self.low, self.high, self.n = (np.array([r[c] for r in cells], np.float64) for c in ("low", "high", "n"))
        self.read: list[dict[str, int]] = []

    def _bounds(self, queries: np.ndarray) -> np.ndarray:
        """Of each query and cell the least distance that a row can have."""
        d = _distances(queries, self.centres)
        return np.maximum(np.maximum(d - self.high, self.low - d), 0)

    def _probe(self, asked: dict[int, np.ndarray], ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
        """The best rows of the asked cells, for the queries that ask each; of each task at most k a query."""
        shared = self.spark.sparkContext.broadcast((asked, ids, queries, floor))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, ids, queries, floor = shared.value
            held = Best(k, len(ids), pa.int64())
            held.floor = floor.copy()
            for batch in batches:
                cells = batch.column(2).to_numpy()
                for cell in np.unique(cells).tolist():
                    rows = np.flatnonzero(cells == cell)
                    of = asked[cell]
                    x = np.stack(batch.column(1).take(pa.array(rows)).to_numpy(zero_copy_only=False))
                    held.scan(batch.column(0).take(pa.array(rows)), x, queries, of)
            held.merge()
            yield pa.RecordBatch.from_arrays([pa.array(ids[held.query]), held.ids, pa.array(held.values[:, 0])], ["query_id", "doc_id", "score"])

        rows = self.spark.read.schema("id long, v array<double>, cell int").parquet(f"{self.path}/rows").where(F.col("cell").isin(list(asked)))
        return rows.select("id", "v", "cell").mapInArrow(run, "query_id long, doc_id long, score double")

    def search(self, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, doc_id, score, rank of the k nearest rows by cosine, as from a scan; ties by document. Queries without a
        vector have no rows. Queries go to every task in blocks of at most BLOCK_BYTES, and as many as DISTANCES allows."""
        asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
        size = asked.agg(F.sum(F.size("v") * 8).alias("bytes"), F.count("*").alias("n")).first()
        blocks = max(1, -(-(size.bytes or 0) // BLOCK_BYTES), -(-size.n * max(1, len(self.cells)) // DISTANCES))
        folder, self.read = work_dir(self.spark, "probes"), []
        schema = "query_id long, doc_id long, score double"
        self.spark.createDataFrame([], schema).write.parquet(f"{folder}/none")
        for block in range(blocks):
            rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().combine_chunks()
            if rows.num_rows and len(self.cells):
                self._search_block(rows.column(0).to_numpy(), _units(rows.column(1).combine_chunks()), k, f"{folder}/block-{block}-")
        found = self.spark.read.schema(schema).parquet(f"{folder}/*")
        return best(found, k)

    def _search_block(self, ids: np.ndarray, queries: np.ndarray, k: int, folder: str) -> None:
        """Probe until nothing nearer can be left; each round writes what it finds."""
        bounds = self._bounds(queries)
        order = np.argsort(bounds, axis=1, kind="stable")
        ordered = np.take_along_axis(bounds, order, axis=1)
        begin, number, cells = np.zeros(len(ids), np.int64), 0, set()
        worst = np.full(len(ids), np.inf)
        floor = np.full(len(ids), -np.inf)
        place = {q: i for i, q in enumerate(ids.tolist())}
        while True:
            end = np.where(begin == 0, FIRST, begin * 4)
            nth = np.arange(len(self.cells))
            wanted = (nth >= begin[:, None]) & (nth < end[:, None]) & (ordered <= worst[:, None] + SLACK)
            query, at = np.nonzero(wanted)
            if not len(query):
                return
            cell = order[query, at]
            by_cell = np.argsort(cell, kind="stable")
            cuts = np.flatnonzero(np.diff(cell[by_cell])) + 1
            asked = {int(self.cells[cell[own[0]]]): query[own] for own in np.split(by_cell, cuts)}
            cells |= set(cell.tolist())
            self._probe(asked, ids, queries, floor, k).write.parquet(f"{folder}{number}")
            number, begin = number + 1, np.minimum(end, len(self.cells))
            # the k-th best so far, a row a query
            so_far = best(self.spark.read.parquet(f"{folder}*"), k).where(F.col("rank") == k).select("query_id", "score").collect()
            for r in so_far:
                i = place[r.query_id]
                floor[i] = r.score
                worst[i] = np.sqrt(max(0.0, 2 - 2 * (r.score - 0.5 * 10.0**-DIGITS)))
            done = {"cells": len(cells), "of_cells": len(self.cells), "rows": int(self.n[sorted(cells)].sum()), "of_rows": int(self.n.sum()), "rounds": number}
            self.read = [*self.read[: int(folder.rsplit("-", 2)[1])], done]

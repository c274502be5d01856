"""Retrievers: ranked lists (query_id, doc_id, score, rank) of the best k documents for each query.

The queries are the small, stated side: their terms or vectors go to every task, in blocks of bounded size. The corpus is
scanned once for the statistics of the asked terms (lexical only) and once to score. A task scores its documents against
all queries of the block as arrays and keeps the k best of each, so k rows a query and task are all that is shuffled: no
postings, and no pairs of a query and a document. Scores are rounded before they rank, so ties are ties on any plan; they
go by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

K1, B = 1.5, 0.75
DIGITS = 6
#: Rows of query terms, and bytes of query vectors, that go to every task at a time; more queries make more blocks.
BLOCK_TERMS, BLOCK_BYTES = 500_000, 32 << 20
#: Scores, and pairs of a document's term and a query, that are held at a time; and bytes of text that are split at a time.
SCORES, PAIRS, SLICE = 1 << 19, 1 << 19, 4 << 20
#: Rows that are scored at a time against some of the query vectors; and rows that wait at least before they are merged.
ROWS, WAIT = 2_048, 1 << 16


def best(df: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), doc: str = "doc_id") -> DataFrame:
    """The k rows of highest score for each query, with their rank from 1; ties by document."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), doc)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, words)."""
    return queries.select("query_id", F.explode("words").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def rounded(x: np.ndarray) -> np.ndarray:
    """To DIGITS digits, halves up."""
    return np.floor(x * 10.0**DIGITS + 0.5) / 10.0**DIGITS


class Best:
    """The k best documents of each of n queries, as far as they have been seen; ties by document. What is added waits until it
    is as much as what is held; merge() takes in what still waits."""

    def __init__(self, k: int, n: int, ids: pa.DataType) -> None:
        self.k = k
        #: What a score must reach to be of use.
        self.floor = np.full(n, -np.inf)
        self.query, self.values, self.ids = np.zeros(0, np.int64), np.zeros((0, 3)), pa.array([], ids)
        self.waiting: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, query: np.ndarray, ids: pa.Array, values: np.ndarray) -> None:
        """values: a row of score and two more numbers for each."""
        self.waiting.append((query, ids, values))
        self.n_waiting += len(query)
        if self.n_waiting > max(WAIT, len(self.query)):
            self.merge()

    def merge(self) -> None:
        if not self.n_waiting:
            return
        self.query = np.concatenate([self.query, *(q for q, _, _ in self.waiting)])
        self.values = np.concatenate([self.values, *(v for _, _, v in self.waiting)])
        self.ids = pa.concat_arrays([self.ids, *(i for _, i, _ in self.waiting)])
        self.waiting, self.n_waiting = [], 0
        place = pc.rank(self.ids, tiebreaker="dense").to_numpy()
        order = np.lexsort((place, -self.values[:, 0], self.query))
        sorted_query = self.query[order]
        nth = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
        order = order[nth < self.k]
        last = self.query[order][nth[nth < self.k] == self.k - 1]
        self.query, self.values, self.ids = self.query[order], self.values[order], self.ids.take(pa.array(order))
        self.floor[last] = self.values[np.flatnonzero(nth[nth < self.k] == self.k - 1), 0]

    def useful(self, score: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where scores, a row for each of the queries `of`, may be among the k best; of what is alike to the k-th here all."""
        there = score >= self.floor[of][:, None]
        if score.shape[1] > self.k and np.count_nonzero(there) > self.k * len(of):
            there &= score >= np.partition(score, -self.k, axis=1)[:, -self.k, None]
        return np.nonzero(there)

    def scan(self, ids: pa.Array, x: np.ndarray, queries: np.ndarray, of: np.ndarray) -> None:
        """Take in the products of rows and the queries `of`, some of both at a time."""
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS]
            for first in range(0, len(of), width := max(1, SCORES // len(part))):
                own = of[first : first + width]
                score = rounded(queries[own] @ part.T)
                query, row = self.useful(score, own)
                if len(row):
                    self.add(own[query], ids.take(pa.array(at + row)), np.repeat(score[query, row][:, None], 3, axis=1))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smaller batches, unless a single text is large."""
    for batch in batches:
        step = max(1, int(batch.num_rows * min(1.0, SLICE / max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _counted(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with single spaces: number of words and norm of the term frequencies of each; and of each asked term in a text: row, term, frequency."""
    n = len(texts)
    whole = texts.take(pa.array(range(n), pa.int64())).cast(pa.large_string())  # the split kernel misreads slices
    lists = pc.split_pattern(whole, " ")
    coded = lists.flatten().dictionary_encode()
    vocabulary = coded.dictionary
    code = coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    blank = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
    pairs, tf = np.unique((row * max(len(vocabulary), 1) + code)[code != blank], return_counts=True)
    row, code = pairs // max(len(vocabulary), 1), pairs % max(len(vocabulary), 1)
    length, norm = np.bincount(row, tf, n), np.sqrt(np.bincount(row, tf.astype(np.float64) ** 2, n))
    term = pc.fill_null(pc.index_in(vocabulary, value_set=terms), -1).to_numpy()[code] if len(vocabulary) else code
    asked = term >= 0
    return length, norm, row[asked], term[asked], tf[asked]


class _Block:
    """Some of the queries: what a task needs to know of them."""

    def __init__(self, rows: list) -> None:
        self.queries = sorted({r.query_id for r in rows})
        number = {q: i for i, q in enumerate(self.queries)}
        names = sorted({r.term for r in rows})
        place = {t: i for i, t in enumerate(names)}
        self.terms = pa.array(names, pa.large_string())
        at = np.array([place[r.term] for r in rows], np.int64)
        order = np.argsort(at, kind="stable")
        self.query = np.array([number[r.query_id] for r in rows], np.int64)[order]
        self.qtf = np.array([r.qtf for r in rows], np.float64)[order]
        #: The queries of a term are those between its bounds.
        self.bounds = np.searchsorted(at[order], np.arange(len(names) + 1))
        self.qnorm = np.sqrt(np.bincount(self.query, self.qtf**2, len(self.queries)))
        self.idf, self.mean = np.zeros(len(names)), 1.0

    def learn(self, docs: DataFrame) -> None:
        """Number and mean length of documents, and the weight of each term, from one scan."""
        terms = docs.sparkSession.sparkContext.broadcast(self.terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = len(terms.value)
            seen = np.zeros(n + 2, np.int64)
            for batch in _split(batches):
                length, _, _, term, _ = _counted(batch.column(1), terms.value)
                seen += np.bincount(term, minlength=n + 2)
                seen[n:] += (len(length), int(length.sum()))
            there = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], ["term", "n"])

        found = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        seen = np.zeros(len(self.terms) + 2)
        for r in found:
            seen[r.term] = r.n
        n, df = seen[-2], seen[:-2]
        self.mean = seen[-1] / n if n and seen[-1] else 1.0
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def scores(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """BM25, cosine and number of covered terms, a row for each query and a column for each text, for some texts at a time: as many as
        have SCORES of them and PAIRS of a term and a query that asks for it, or one. The first number tells which text they begin with."""
        width = len(self.queries)
        length, norm, all_rows, all_terms, all_tf = _counted(texts, self.terms)
        begin = np.searchsorted(all_rows, np.arange(len(texts) + 1))
        pairs = np.concatenate([[0], np.cumsum(self.bounds[all_terms + 1] - self.bounds[all_terms])])[begin]
        at = 0
        while at < len(texts):
            end = min(at + max(1, SCORES // max(width, 1)), max(at + 1, int(np.searchsorted(pairs, pairs[at] + PAIRS, "right")) - 1))
            n, own = min(end, len(texts)) - at, slice(begin[at], begin[min(end, len(texts))])
            row, term, tf = all_rows[own] - at, all_terms[own], all_tf[own]
            weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[at + row] / self.mean))
            many = self.bounds[term + 1] - self.bounds[term]
            of = np.repeat(self.bounds[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
            cell = self.query[of] * n + np.repeat(row, many)
            sums = lambda x, cell=cell, n=n: np.bincount(cell, x, n * width).reshape(width, n)
            dot = sums(np.repeat(tf, many) * self.qtf[of])
            yield at, rounded(sums(np.repeat(weight, many))), rounded(dot / np.maximum(norm[at : at + n] * self.qnorm[:, None], 1e-300)), sums(np.ones(len(cell)))
            at += n

    def ranked(self, docs: DataFrame, tops: dict[str, int]) -> DataFrame:
        """Of each task the best of each query: ranking, q, doc_id, score, bm25, coverage."""
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, held = shared.value, {}
            width = len(block.queries)
            every = np.arange(width)
            for batch in _split(batches):
                ids = batch.column(0)
                for at, bm25, cosine, coverage in block.scores(batch.column(1)):
                    for name, k in tops.items():
                        score = np.where(coverage > 0, bm25 if name == "bm25" else cosine, -np.inf)
                        own = held.setdefault(name, Best(k, width, ids.type))
                        query, row = own.useful(score, every)
                        there = coverage[query, row] > 0
                        query, row = query[there], row[there]
                        if len(row):
                            own.add(query, ids.take(pa.array(at + row)), np.column_stack([x[query, row] for x in (score, bm25, coverage)]))
            for name, own in held.items():
                own.merge()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own.query), pa.string()), pa.array(own.query), own.ids, *(pa.array(own.values[:, i]) for i in range(3))], ["ranking", "q", "doc_id", "score", "bm25", "coverage"])

        kinds = [StructField("ranking", StringType()), StructField("q", LongType()), docs.schema["doc_id"], *(StructField(c, DoubleType()) for c in ("score", "bm25", "coverage"))]
        return docs.mapInArrow(run, StructType(kinds))


class Corpus:
    """A searchable corpus: documents (doc_id, text), and the queries (query_id, words) that are asked of it.

    Its statistics are taken when it is made; the rankings are plans.
    """

    def __init__(self, docs: DataFrame, queries: DataFrame) -> None:
        self.docs = docs.select("doc_id", F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"(?U)\s+", " ").alias("text"))
        self.terms = query_terms(queries)
        self.kind = self.terms.schema["query_id"]
        n = max(1, -(-self.terms.count() // BLOCK_TERMS))
        self.blocks = []
        for i in range(n):
            if rows := self.terms.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).collect():
                self.blocks.append(_Block(rows))
                self.blocks[-1].learn(self.docs)

    def ranked(self, **tops: int) -> DataFrame:
        """ranking (bm25 or cosine), query_id, doc_id, score, rank, bm25, coverage: of each ranking so many, all from one scan."""
        spark, out = self.docs.sparkSession, []
        for block in self.blocks:
            names = spark.createDataFrame(list(enumerate(block.queries)), StructType([StructField("q", LongType()), self.kind]))
            found = [best(block.ranked(self.docs, tops).where(F.col("ranking") == name), k, ("q",)) for name, k in tops.items()] if len(set(tops.values())) > 1 else [best(block.ranked(self.docs, tops), next(iter(tops.values())), ("ranking", "q"))]
            out.append(reduce(DataFrame.unionByName, found).join(F.broadcast(names), "q"))
        if not out:
            empty = StructType([StructField("ranking", StringType()), self.kind, self.docs.schema["doc_id"], StructField("score", DoubleType()), StructField("rank", LongType()), StructField("bm25", DoubleType()), StructField("coverage", DoubleType())])
            return spark.createDataFrame([], empty)
        return reduce(DataFrame.unionByName, out).select("ranking", "query_id", "doc_id", "score", "rank", "bm25", "coverage")

    def lists(self, **tops: int) -> DataFrame:
        """Those rankings as lists for fusion: list_no counts them in the order given."""
        number = F.array_position(F.array(*[F.lit(name) for name in tops]), F.col("ranking")).cast("int") - 1
        return self.ranked(**tops).select("query_id", "doc_id", "score", "rank", number.alias("list_no"))

    def bm25(self, k: int = 20) -> DataFrame:
        return self.ranked(bm25=k).select("query_id", "doc_id", "score", "rank")

    def cosine(self, k: int = 20) -> DataFrame:
        """Cosine of term-frequency vectors: the default embedding."""
        return self.ranked(cosine=k).select("query_id", "doc_id", "score", "rank")


def _unit(batch: pa.RecordBatch | pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Ids and unit vectors in double precision of the rows that have one."""
    there = batch.filter(pc.is_valid(batch.column(1)))
    ids, vectors = there.column(0), there.column(1)
    if not len(ids):
        return ids, np.zeros((0, 0))
    x = np.stack(vectors.to_numpy(zero_copy_only=False) if isinstance(vectors, pa.Array) else vectors.to_numpy()).astype(np.float64)
    return ids, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact cosine neighbours: query_id, doc_id, score, rank. Rows without a vector are left out.

    Queries go to every task in blocks of at most BLOCK_BYTES; each block is one pass over the corpus.
    """
    spark = corpus.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where("v IS NOT NULL")
    size = asked.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    n, out = max(1, -(-size // BLOCK_BYTES)), []
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    for i in range(n):
        shared = spark.sparkContext.broadcast(_unit(asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).toArrow()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own_ids, own = shared.value
            held = Best(k, len(own), pa.int64())
            every = np.arange(len(own))
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    ids, x = _unit(batch.slice(at, ROWS))
                    if len(ids) and len(own):
                        held.scan(ids, x, own, every)
            held.merge()
            yield pa.RecordBatch.from_arrays([own_ids.take(pa.array(held.query)).combine_chunks() if isinstance(own_ids, pa.ChunkedArray) else own_ids.take(pa.array(held.query)), held.ids, pa.array(held.values[:, 0])], ["query_id", "doc_id", "score"])

        out.append(best(rows.mapInArrow(run, "query_id long, doc_id long, score double"), k))
    return reduce(DataFrame.unionByName, out)

"""Putting ranked lists together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def concatenated(lists: list[DataFrame]) -> DataFrame:
    """All rows of all lists, in their order: list_no is added; nothing is merged."""
    return reduce(DataFrame.unionByName, [df.withColumn("list_no", F.lit(i)) for i, df in enumerate(lists)])


def reciprocal_rank_fusion(ranked: DataFrame, top: int = 5, k: int = RRF_K, doc: str = "doc_id") -> DataFrame:
    """Of rows (query_id, list_no, rank, doc_id): the documents of the greatest sums of 1 / (k + rank), with that as score.

    Ties go by the first list and rank in which a document appears, then by document. Where metadata makes documents differ,
    doc is a column with a key of all of it (scalars.document_key).
    """
    fused = ranked.groupBy("query_id", doc).agg(F.round(F.sum(1.0 / (F.col("rank") + k)), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", doc)
    return fused.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).select("query_id", doc, "score", "rank")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

"""From raw documents to training sequences: five stages, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm.decontaminate import decontaminate
from tamarisk.llm.line_dedup import line_dedup
from tamarisk.llm.minhash import near_duplicates
from tamarisk.llm.packing import best_fit
from tamarisk.llm.tables import drop_at_end, shared_dir, stored, table
from tamarisk.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WHITE = r"[\x20\x09-\x0D]"

# Every stage takes a table with the columns of documents, reads whole texts, and treats a null text as an empty one. Other
# columns are left out, whatever their names; repeated rows are judged alike; an empty table gives an empty table.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; all, if the labels hold but one class. Rows without an id are judged
    like others."""
    return toxicity(docs, table(spark, sf_dir, "labels"), columns=list(COLUMNS)).where("NOT toxic").drop("score", "toxic")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; documents of which nothing but white space is left go. Rows
    without an id are one document after all others; of ties the least id keeps the line."""
    cut = line_dedup(docs, columns=["doc_id", "lang", "source", "n_chars"])
    emptied = (F.col("_n_dropped") > 0) & (F.regexp_replace("_kept", WHITE, "") == "")
    n_chars = F.when(F.col("_n_dropped") > 0, F.char_length("_kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~emptied).select("doc_id", F.col("_kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id. Rows without an id stay; rows that repeat an id go or
    stay together."""
    gone = stored(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Rows without an id are judged together: all go if one is hit."""
    hit = stored(decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("hit")), "contaminated")
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("hit")), "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of the permitted lengths, with their tokens: bytes of UTF-8, and 0xFF after each
    document. The pieces of a bin_id in order of bin_offset are a sequence."""
    return best_fit(docs, content=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]
#: SQL can express neither the classifier nor best fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    drop_at_end(spark, folder)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs

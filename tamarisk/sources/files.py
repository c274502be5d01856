"""Readers and writers for the file formats that retrieval and evaluation data come in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Schemas of evaluation and inquiry data.
EXAMPLES = "question string, context string, answer string"
INQUIRY_EXAMPLES = "inputs struct<customer_name:string,company_name:string,content:string>, expected_outputs struct<topic:string,response_body:string>"
SEEDS = (
    "customer_name string, customer_email string, company_name string, content string, status string, topic string, original_topic string, operator_edited_topic boolean, "
    "classification_confidence double, quality_alert boolean, edit_distance double, minutes_ago int, updated_minutes_ago int, sent_minutes_ago int, "
    "ai_response struct<subject:string,body:string,quality_scores:struct<politeness:string,politeness_reason:string>>, final_response struct<subject:string,body:string>"
)


def read_examples_csv(spark: SparkSession, path: str) -> DataFrame:
    """Questions, expected context labels and answers; quoted fields may span lines, a byte-order mark is skipped."""
    return spark.read.schema(EXAMPLES).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _read_yaml(spark: SparkSession, path: str, schema: str, key: str | None) -> DataFrame:
    """Small configuration-like files: one task parses each file whole."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for batch in batches:
            rows = [r for text in batch["value"] for r in ((yaml.safe_load(text) or {}).get(key) or [] if key else yaml.safe_load(text) or [])]
            yield pd.DataFrame({"json": [json.dumps(r, default=str) for r in rows]})

    raw = spark.read.text(path, wholetext=True)
    return raw.mapInPandas(parse, "json string").select(F.from_json("json", kind).alias("r")).select("r.*")


def read_inquiry_examples(spark: SparkSession, path: str) -> DataFrame:
    return _read_yaml(spark, path, INQUIRY_EXAMPLES, "dataset")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return _read_yaml(spark, path, SEEDS, None)


def flatten_examples(df: DataFrame) -> DataFrame:
    """Nested inputs and expected outputs as five columns; what is missing is null."""
    return df.select("inputs.customer_name", "inputs.company_name", "inputs.content", F.col("expected_outputs.topic").alias("expected_topic"), F.col("expected_outputs.response_body").alias("expected_response_body"))


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """WebVTT cues: start_ms, end_ms, text. Cues are separated by empty lines."""
    clock = r"(?:(\d+):)?(\d\d):(\d\d)\.(\d\d\d)"
    line = rf"(?m)^{clock}\s+-->\s+{clock}[^\n]*\n?"

    def ms(first: int) -> Column:
        g = lambda i: F.coalesce(F.regexp_extract("value", line, i).try_cast("long"), F.lit(0).cast("long"))
        return ((g(first) * 60 + g(first + 1)) * 60 + g(first + 2)) * 1000 + g(first + 3)

    raw = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").rlike(line))
    return raw.select(ms(1).alias("start_ms"), ms(5).alias("end_ms"), F.regexp_replace(F.regexp_replace("value", rf"(?s)^.*?{line}", ""), r"^\s+|\s+$", "").alias("text"))


def scan_documents(spark: SparkSession, folder: str, parse: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """Files below a folder, one row per page: page_content, source, page (from 0). parse gives a file's pages."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(text, path, i) for path, content in zip(batch["path"], batch["content"], strict=True) for i, text in enumerate(parse(content))]
            yield pd.DataFrame(rows, columns=["page_content", "source", "page"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "content").mapInPandas(pages, "page_content string, source string, page int")


def parse_bodies(df: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """JSON request bodies as a struct column `request`; null where a body can't be read."""
    return df.withColumn("request", F.from_json(body, schema, {"mode": "PERMISSIVE"}))


def rebuild_index(df: DataFrame, path: str) -> None:
    """Replace a vector index: rows with an id and an array<float>."""
    df.write.mode("overwrite").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_row(df: DataFrame, by: list[str], version: str, ties: list[str]) -> DataFrame:
    """The row of the greatest version of each name."""
    w = Window.partitionBy(*by).orderBy(F.desc(version), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def append_facts(df: DataFrame, path: str) -> None:
    """Feedback, traces and messages are append-only."""
    df.write.mode("append").parquet(path)

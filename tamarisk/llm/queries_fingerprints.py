"""op13: the query. SQL has not the hashes of the fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarisk.llm.fingerprints import edited_neighbours
from tamarisk.llm.tables import table


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))


QUERIES = {"op13_fingerprints": op13_fingerprints}
SQL: dict[str, str] = {}

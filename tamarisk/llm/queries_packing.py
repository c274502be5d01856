"""op3: the query. SQL cannot express best fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarisk.llm.packing import best_fit
from tamarisk.llm.tables import table


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))


QUERIES = {"op3_best_fit": op3_best_fit}
SQL: dict[str, str] = {}

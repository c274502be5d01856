"""op5: the query. SQL cannot express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarisk.llm.html_extract import main_text
from tamarisk.llm.tables import table


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_extract": op5_html_extract}
SQL: dict[str, str] = {}

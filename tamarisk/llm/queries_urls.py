"""op6: the query. SQL cannot express the trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarisk.llm.tables import table
from tamarisk.llm.url_filter import judge_urls

#: The rules of the query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


QUERIES = {"op6_url_filter": op6_url_filter}
SQL: dict[str, str] = {}

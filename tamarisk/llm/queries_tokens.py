"""op10: the query. SQL cannot express it."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tamarisk.llm.tables import table
from tamarisk.llm.token_files import token_digests


def op10_token_files(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    text = Path(tokenizer_file or public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    return token_digests(table(spark, sf_dir, "documents"), text)


QUERIES = {"op10_token_files": op10_token_files}
SQL: dict[str, str] = {}

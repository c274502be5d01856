"""op11: the query. SQL cannot express the tokenizers."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tamarisk.llm.tables import table
from tamarisk.llm.token_alignment import token_alignment


def op11_token_alignment(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None, model_file: str | None = None) -> DataFrame:
    a = Path(tokenizer_file or public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    b = Path(model_file or public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return token_alignment(table(spark, sf_dir, "documents"), a, b)


QUERIES = {"op11_token_alignment": op11_token_alignment}
SQL: dict[str, str] = {}

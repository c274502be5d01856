"""Scores of predictions, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(predicted: Column, expected: Column) -> Column:
    """1 where both are equal, else 0; a missing prediction is wrong."""
    return F.coalesce((predicted == expected).cast("int"), F.lit(0))


def context_recall(expected: DataFrame, retrieved: DataFrame, key: str, label: str) -> DataFrame:
    """(key, score): 1 if the expected label is among those retrieved, else 0."""
    hit = retrieved.select(key, label).distinct().withColumn("_hit", F.lit(1))
    return expected.join(hit, [key, label], "left").groupBy(key).agg(F.coalesce(F.max("_hit"), F.lit(0)).alias("score"))


def judgement_score(value: Column, good: str, bad: str) -> Column:
    return F.when(value == good, 1).when(value == bad, 0)


def summary(scores: DataFrame, key: str = "key", score: str = "score") -> DataFrame:
    """Mean and number of scores of each scorer; skipped ones (null) do not count."""
    return scores.groupBy(key).agg(F.round(F.avg(score), 6).alias("mean_score"), F.count(score).alias("n_scored"))


def unpivoted(df: DataFrame, key: str, scorers: list[str]) -> DataFrame:
    """One row for each example and scorer: key, key column name as `key`, score."""
    return df.unpivot(F.col(key), [F.col(s) for s in scorers], "key", "score")

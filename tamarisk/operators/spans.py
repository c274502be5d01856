"""Call trees: spans with a parent, and totals over the subtree of each by pointer jumping.

In round k every span knows its ancestor at distance 2^k and the totals of its descendants up to distance 2^k - 1. It passes
them on to that ancestor, and takes the ancestor's ancestor for the next round. So the number of rounds is the logarithm of the
depth, however long the chains of calls, and a round shuffles one row a span that still has an ancestor that far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.sources.tables import work_dir

#: Deeper trees than 2 to the power of this are none: their spans go round in a circle.
ROUNDS = 40


def subtree_totals(spans: DataFrame, amounts: list[str], span: str = "span_id", parent: str = "parent_id") -> DataFrame:
    """span, parent, depth (0 at roots), n_spans and the sum of each amount over the span and all below it.

    A parent that is not there makes its children roots. Null amounts count as zero. Span ids are distinct; spans whose
    parents go round in a circle raise an error. An empty table gives no rows.
    """
    spark, folder = spans.sparkSession, work_dir(spans.sparkSession, "spans")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    totals = ["n_spans", *amounts]
    own = spans.select(F.col(span).alias("id"), F.col(parent).alias("up"), F.lit(1).cast("long").alias("n_spans"), *[F.coalesce(F.col(a), F.lit(0)).alias(a) for a in amounts])
    there = own.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    first = stored(own.join(there, "up", "left").select("id", F.when(F.col("there"), F.col("up")).alias("up"), *totals), "0")
    links, sums = first.where("up IS NOT NULL").select("id", "up", F.lit(1).cast("long").alias("distance")), first.select("id", *totals)
    depth = links
    for k in range(1, ROUNDS + 1):
        if links.isEmpty():
            break
        # what is passed to the ancestor at this distance
        passed = links.select("id", "up").join(sums, "id").groupBy("up").agg(*[F.sum(c).alias(f"_{c}") for c in totals]).withColumnRenamed("up", "id")
        sums = stored(sums.join(passed, "id", "left").select("id", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).cast(sums.schema[c].dataType).alias(c) for c in totals]), f"{k}-sums")
        # and where the next round's ancestor is; the last one found tells how deep a span lies
        beyond = links.select(F.col("id").alias("up"), F.col("up").alias("next"))
        links = stored(links.join(beyond, "up").select("id", F.col("next").alias("up"), (2 * F.col("distance")).alias("distance")), f"{k}-links")
        deeper = depth.join(depth.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("distance").alias("more")), "up", "left")
        depth = stored(deeper.select("id", F.coalesce("next", "up").alias("up"), (F.col("distance") + F.coalesce("more", F.lit(0))).alias("distance")), f"{k}-depth")
    else:
        raise ValueError("parents of spans go round in a circle")
    levels = depth.select("id", F.col("distance").alias("depth"))
    found = first.select("id", "up").join(sums, "id").join(levels, "id", "left")
    return found.select(F.col("id").alias(span), F.col("up").alias(parent), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), *totals)

"""Where intermediate tables live, and small helpers that every operator here shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of our own: below the warehouse on
    a cluster, a temporary one only where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        alone = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        found = "file://" + tempfile.mkdtemp(prefix="tamarisk-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tamarisk"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def drop_at_end(spark: SparkSession, path: str) -> None:
    """The folder goes when the session's JVM ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def passed_through(df: DataFrame, columns: list[str] | tuple[str, ...], results: tuple[str, ...]) -> list[str]:
    """The columns that go to the result as they are. A result column takes the place of an input column of its name."""
    taken = {c.lower() for c in results}
    return [c for c in dict.fromkeys(columns) if c.lower() not in taken]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    The folder goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def held(columns: list[str]) -> Column:
    """The columns as one, own, so that their names meet no others on the way."""
    return (F.struct(*columns) if columns else F.lit(None).cast("boolean")).alias("own")


def let_go(columns: list[str]) -> list[Column]:
    return [F.col("own")[c].alias(c) for c in columns]


def whole_text(name: str = "text") -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

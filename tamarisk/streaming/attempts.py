"""Calls of remote models row by row: a row whose call fails is tried again, and ends as an error of its own.

An exception of one call neither stops the batch nor costs the other rows their results. Rows that failed to the end go to a
table of dead letters with what was said, from which they can be tried again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, _parse_datatype_string

TRIES = 3
#: Characters of an error that are kept.
ERROR_CHARS = 500

Call = Callable[[dict, int], dict]


def attempted(rows: DataFrame, call: Call, result: str, tries: int = TRIES) -> DataFrame:
    """rows with result (a struct of the named fields; null where all tries failed), attempts, and error (null where one did not
    fail). call(row as a dict, number of the try from 1) gives the fields of the result. Columns of these names give way."""
    kind = _parse_datatype_string(result)
    own = rows.drop("result", "attempts", "error")
    arrow = to_arrow_type(kind)

    def one(row: dict) -> tuple[dict | None, int, str | None]:
        said = None
        for number in range(1, tries + 1):
            try:
                # an answer of other types is a failure of this row, too
                return pa.array([call(row, number)], arrow)[0].as_py(), number, None
            except Exception as e:  # noqa: BLE001  whatever a model throws is that row's error
                said = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
        return None, tries, said

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(row) for row in batch.to_pylist()]
            columns = [pa.array([f[0] for f in found], arrow), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "result", "attempts", "error"])

    return own.mapInArrow(run, StructType([*own.schema, StructField("result", kind), StructField("attempts", IntegerType()), StructField("error", StringType())]))


def attempt_stream(stream: DataFrame, path: str, checkpoint: str, call: Call, result: str, tries: int = TRIES):
    """Each micro-batch is called once and written below path, what succeeded as outcome=done, the rest as outcome=dead. A batch
    that runs again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        found = attempted(batch, call, result, tries).withColumn("outcome", F.when(F.col("error").isNull(), "done").otherwise("dead"))
        found.write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """All rows that were called, with batch and outcome."""
    return spark.read.parquet(path)


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Rows to call again, as they came in, with attempts and error of the last time."""
    return outcomes(spark, path).where("outcome = 'dead'").drop("result", "outcome", "batch")

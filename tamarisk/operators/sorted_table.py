"""A table laid out for its pages: sorted by a filter column and a time, with what each file holds in a table of its own.

Rows are ranged over files by (filter column, time from the newest, key). The file table has each file's first and last place
in that order and its number of rows, so a page is read from the files that hold it: a page begins behind the last row of the
page before, never at an offset whose rows would have to be read and thrown away. For single rows the file table also has
a Bloom filter of the keys of each file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a Bloom filter for each key of a file, and hashes of a key. A filter is kept in pieces of so many bits.
KEY_BITS, HASHES, PIECE = 10, 4, 32_768
#: Rows of a file at most, about: a task sorts one file.
FILE_ROWS = 200_000


def _bit(key: Column, number: int, bits: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(number)), bits)


class SortedTable:
    """Rows by (by, time descending, key). read has the files that the last page or lookup read, of_files how many there are."""

    def __init__(self, spark: SparkSession, path: str, by: str, time: str, key: str) -> None:
        self.spark, self.path, self.by, self.time, self.key = spark, path, by, time, key
        self.read, self.of_files = 0, 0

    def _order(self) -> list[Column]:
        return [F.col(self.by).asc_nulls_first(), F.col(self.time).desc_nulls_last(), F.col(self.key).asc_nulls_first()]

    def build(self, rows: DataFrame, files: int) -> None:
        """Write rows in about so many files, more if they would have more than FILE_ROWS rows, and the file table. Rows of one
        status are ranged by time, so none is too many."""
        files = max(files, -(-rows.count() // FILE_ROWS))
        rows.repartitionByRange(files, *self._order()).sortWithinPartitions(*self._order()).write.parquet(f"{self.path}/rows")
        stored = self.spark.read.parquet(f"{self.path}/rows").select(F.input_file_name().alias("file"), F.col(self.by).alias("by"), F.col(self.time).alias("time"), F.col(self.key).alias("key"))
        ends = stored.groupBy("file", "by").agg(F.max("time").alias("newest"), F.min("time").alias("oldest"), F.count("*").alias("n"), F.count_if(F.col("time").isNull()).alias("n_untimed"))
        ends.write.parquet(f"{self.path}/files")
        # a scan may take many files at once, whose bits a task would sort together
        keys = stored.select("file", "key").repartition(files, "file")
        size = stored.groupBy("file").agg((KEY_BITS * F.count("*")).alias("bits"))
        bits = keys.join(F.broadcast(size), "file").select("file", "bits", F.explode(F.array(*[_bit(F.col("key"), i, F.col("bits")) for i in range(HASHES)])).alias("at"))
        pieces = bits.groupBy("file", "bits", F.floor(F.col("at") / PIECE).alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % PIECE).alias("bitmap"))
        pieces.write.parquet(f"{self.path}/keys")

    def _rows(self, files: list[str]) -> DataFrame:
        every = self.spark.read.parquet(f"{self.path}/rows")
        return self.spark.read.schema(every.schema).parquet(*files) if files else every.limit(0)

    def page(self, value: object, limit: int, after: tuple | None = None) -> DataFrame:
        """The next rows whose filter column has the value, the newest first, behind the row (time, key); the first ones if none
        is given. Rows without a time come last."""
        table = self.spark.read.parquet(f"{self.path}/files")
        self.of_files = table.select("file").distinct().count()
        own = table.where(F.col("by").eqNullSafe(F.lit(value)))
        behind = F.lit(True)
        if after is not None:
            time, key = after
            behind = F.col(self.time).isNull() & (F.col(self.key) > F.lit(key)) if time is None else F.col(self.time).isNull() | (F.col(self.time) < F.lit(time)) | (F.col(self.time) == F.lit(time)) & (F.col(self.key) > F.lit(key))
            own = own.where(F.col("n_untimed") > 0) if time is None else own.where((F.col("n_untimed") > 0) | (F.col("oldest") <= F.lit(time)))
        # in order of the files a row each; the first ones may lie before the place in part, so their rows are not counted on
        wanted, sure = [], 0
        for f in own.orderBy(F.col("newest").desc_nulls_last(), F.col("oldest").desc_nulls_last()).toLocalIterator():
            if sure >= limit:
                break
            wanted.append(f.file)
            if after is None or after[0] is not None and f.newest is not None and f.newest < after[0]:
                sure += f.n
        self.read = len(set(wanted))
        return self._rows(sorted(set(wanted))).where(F.col(self.by).eqNullSafe(F.lit(value)) & behind).orderBy(*self._order()).limit(limit)

    def lookup(self, key: object) -> DataFrame:
        """Rows of a key, from the files whose filter may hold it."""
        pieces = self.spark.read.parquet(f"{self.path}/keys")
        self.of_files = pieces.select("file").distinct().count()
        asked = pieces.select("file", "bits").distinct().select("file", F.explode(F.array(*[_bit(F.lit(key), i, F.col("bits")) for i in range(HASHES)])).alias("at"), F.floor(F.col("at") / PIECE).alias("piece"))
        byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("at") % PIECE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.coalesce(F.expr("shiftright(byte, CAST(at % 8 AS INT))").bitwiseAND(F.lit(1)) == 1, F.lit(False))
        found = asked.join(pieces.select("file", "piece", "bitmap"), ["file", "piece"], "left").withColumn("byte", byte).groupBy("file").agg(F.bool_and(is_set).alias("maybe")).where("maybe")
        files = sorted(r.file for r in found.collect())
        self.read = len(files)
        return self._rows(files).where(F.col(self.key) == F.lit(key))

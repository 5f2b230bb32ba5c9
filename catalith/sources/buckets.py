"""A keyed table on disk that is looked up without being read whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.session import exists, remove


class BucketStore:
    """Rows of a schema under path, a folder all executors share, dealt to buckets by a hash of their key.

    A bucket is a folder with one part for each batch that brought it rows. A look-up opens the buckets of the asked
    keys alone; with as many buckets as keep one to some 100 MB, what it reads is bounded by what it asks. The numbers
    of these buckets, at most buckets of them, are all that comes to the driver. Batches have rising numbers; one put
    again replaces itself. Rows with a null key are stored and never found.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 256):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        #: How many buckets the last look-up opened.
        self.opened = 0

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def around(self, asked: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of all buckets into which the asked keys (the first column) fall, of batches before a number if one is given."""
        wanted = sorted(r[0] for r in asked.select(self._bucket(asked.columns[0]).alias("bucket")).distinct().collect())
        paths = [p for b in wanted if exists(self.spark, p := f"{self.path}/bucket={b}")]
        self.opened = len(paths)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.option("basePath", self.path).schema(f"{self.schema}, bucket int, batch long").parquet(*paths)
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("bucket", "batch")

    def get(self, asked: DataFrame, before: int | None = None) -> DataFrame:
        """The rows whose key is among the asked ones (the first column)."""
        rows, key = self.around(asked, before), asked.select(F.col(asked.columns[0]).alias("_asked"))
        return rows.join(key, rows[self.key] == key["_asked"], "left_semi")

    def put(self, rows: DataFrame, number: int) -> None:
        dealt = rows.withColumns({"bucket": self._bucket(self.key), "batch": F.lit(number)}).repartition("bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)

    def truncate(self) -> None:
        """Takes all rows out."""
        remove(self.spark, self.path)

"""The journal: one JSON line a package, its files nested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.hashes import hash_digits

FILE = "file_id BIGINT, blob_hash STRING, role STRING, original_filename STRING, sequence_number INT"
ENTRY = (
    "v INT, package_id BIGINT, supplier_id INT, received_at STRING, package_hash STRING, payload_type STRING, storage_mode STRING, "
    f"canonical_package_id BIGINT, original_filename STRING, file_count INT, unpack_error STRING, files ARRAY<STRUCT<{FILE.replace(' BIGINT', ': BIGINT').replace(' STRING', ': STRING').replace(' INT', ': INT')}>>"
)


def snapshot_lines(packages: DataFrame, files: DataFrame) -> DataFrame:
    """line STRING: the journal line of every package, absent fields left out, files in the order of their ids.

    A package without files has an empty list. Repeated rows count once; a package without an id has no line.
    """
    f = files.select("id", "package_id", hash_digits(F.col("blob_hash")).alias("blob_hash"), "role", "original_filename", "sequence_number").distinct()
    listed = f.groupBy("package_id").agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("file_id"), "blob_hash", "role", "original_filename", "sequence_number"))).alias("files"))
    head = packages.where(F.col("id").isNotNull()).distinct()
    both = head.join(listed, head["id"] == listed["package_id"], "left")
    entry = F.struct(
        F.lit(1).alias("v"),
        F.col("id").alias("package_id"),
        "supplier_id",
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("received_at"),
        hash_digits(F.col("package_hash")).alias("package_hash"),
        "payload_type",
        "storage_mode",
        "canonical_package_id",
        both["original_filename"].alias("original_filename"),
        "file_count",
        "unpack_error",
        F.coalesce("files", F.from_json(F.lit("[]"), f"ARRAY<STRUCT<{FILE}>>")).alias("files"),
    )
    return both.select(F.to_json(entry).alias("line"))


def write_journal(packages: DataFrame, files: DataFrame, path: str) -> None:
    """Appends the lines of packages to the journal at path."""
    snapshot_lines(packages, files).write.mode("append").text(path)


def parse_lines(lines: DataFrame) -> DataFrame:
    """The entries of journal lines (column line); blank lines are skipped, a damaged one is an error."""
    kept = lines.where(F.trim("line") != "")
    return kept.select(F.from_json("line", ENTRY, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a journal; none if path does not exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    if there is None or not len(there):
        return spark.createDataFrame([], ENTRY)
    return parse_lines(spark.read.text(path).withColumnRenamed("value", "line"))

"""Tables of a relational database, and the statements that set tables up."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.sources.journal import FILE
from catalith.sources.segments import opened

#: The tables of a catalog.
SCHEMAS = {
    "packages": "id BIGINT, supplier_id INT, received_at TIMESTAMP, package_hash STRING, payload_type STRING, storage_mode STRING, original_filename STRING, canonical_package_id BIGINT, file_count INT, unpack_error STRING",
    "package_files": FILE.replace("file_id BIGINT", "id BIGINT, package_id BIGINT"),
    "content_blobs": "content_hash STRING, size INT, stored_size INT, segment_id INT, offset BIGINT, ref_count BIGINT, first_seen_at TIMESTAMP",
}


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table, or a query in brackets with an alias, read over JDBC; filters and columns are pushed to the database.

    With key, a number or time column, it is read in parts by ranges between its least and greatest value, which are
    asked for first; rows with a null key come with the first part. options are those of the JDBC source.
    """
    source = spark.read.format("jdbc").option("url", url).options(**options)
    if key:
        low, high = source.option("dbtable", table).load().agg(F.min(key), F.max(key)).first()
        if low is not None:
            source = source.option("partitionColumn", key).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(parts))
    return source.option("dbtable", table).load()


def append_table(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Appends rows to a table over JDBC, made if it is not there."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()


def create_catalog(spark: SparkSession, folder: str) -> None:
    """Makes an empty Parquet table of each of SCHEMAS that the folder lacks; those it has are left alone."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}.parquet")


def run_statements(spark: SparkSession, folder: str) -> list[str]:
    """Runs the statements of the *.sql files of a folder in the order of their names, up to the first error; returns the names of the files done.

    Statements end with a semicolon at the end of a line; lines that begin with -- are left out. Those that ran before
    an error stay as they are.
    """
    system, root = opened(folder)
    done = []
    for info in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda i: i.base_name):
        if info.is_file and info.extension == "sql":
            with system.open_input_stream(info.path) as file:
                lines = [x for x in file.read().decode().splitlines() if not x.lstrip().startswith("--")]
            for statement in "\n".join(x.rstrip() for x in lines).split(";\n"):
                if text := statement.strip().rstrip(";").strip():
                    spark.sql(text)
            done.append(info.base_name)
    return done

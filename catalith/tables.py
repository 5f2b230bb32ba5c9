"""The tables of a data folder, one Parquet table each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table name of the folder, only the given columns if any; columns of type TIMESTAMP_NTZ become TIMESTAMP (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    ntz = {c for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df

"""Uploads made up for load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def made_uploads(spark: SparkSession, n: int, duplicate_ratio: float = 0.3, reservoir: int = 500, filler: int = 400, seed: int = 1) -> DataFrame:
    """id, supplier, received_at, filename, body: n uploads, about duplicate_ratio of which repeat one of the first reservoir bodies.

    Every body is a small XML with about filler bytes of digits of its own. The same numbers give the same uploads, on
    any number of tasks.
    """
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 30)) / float(1 << 30)
    repeats = (F.col("id") >= reservoir) & (draw(0) < duplicate_ratio)
    which = F.when(repeats, F.floor(draw(1) * reservoir)).otherwise(F.col("id"))
    digits = F.sha2(F.concat(F.lit(f"{seed}-"), which.cast("string")), 256)
    body = F.concat(F.lit("<upload n=\""), which.cast("string"), F.lit("\">"), F.substring(F.repeat(digits, -(-filler // 64)), 1, filler), F.lit("</upload>"))
    at = F.timestamp_seconds(F.lit(1_735_689_600) + F.col("id"))
    return spark.range(n).select("id", (F.floor(draw(2) * 1000) + 1).cast("string").alias("supplier"), at.alias("received_at"), F.concat(F.lit("upload_"), F.col("id").cast("string"), F.lit(".xml")).alias("filename"), F.encode(body, "utf-8").alias("body"))

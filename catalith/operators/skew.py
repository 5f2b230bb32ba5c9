"""Joins on keys that may hold much of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_left_join(many: DataFrame, one: DataFrame, key: str, rows: int, salts: int = 32, parts: int = 1000) -> DataFrame:
    """many left join one on key, a column of both, unique in one. rows: at least the rows of many.

    The rows of a key that holds more than 1 / parts of many (and 10,000 rows) are dealt out by a salt, and the row of
    one that they meet goes along with each salt; there are at most parts such keys, so their list is broadcast. Rows
    with a null key meet none and are dealt out too. The salt depends on the row and on the task that read it, so even
    copies of one row are spread, and a task that is run again deals alike.
    """
    hot = many.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(10_000, rows // parts))
    hot = F.broadcast(hot.select(key, F.lit(salts).alias("_salts")))
    width = F.when(F.col(key).isNull(), F.lit(salts)).otherwise(F.coalesce("_salts", F.lit(1)))
    dealt = many.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*many.columns, F.spark_partition_id()), width)).drop("_salts")
    copied = one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)).cast("long") - 1))).drop("_salts")
    return dealt.join(copied, [key, "_salt"], "left").drop("_salt")

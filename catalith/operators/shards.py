"""Shards: global ids, routes and what is measured of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A global id has the shard in its upper 16 bits, the local id in the lower 48.
LOCAL_BITS = 48
LOCAL_MASK = (1 << LOCAL_BITS) - 1


def global_id(shard: Column, local: Column) -> Column:
    """The signed 64-bit id of a shard (0 to 65,535) and a local id; negative from shard 32,768 on."""
    return F.shiftleft(shard.cast("long"), LOCAL_BITS).bitwiseOR(local.cast("long").bitwiseAND(F.lit(LOCAL_MASK)))


def shard_of(gid: Column) -> Column:
    return F.shiftrightunsigned(gid, LOCAL_BITS).cast("int")


def local_of(gid: Column) -> Column:
    return gid.bitwiseAND(F.lit(LOCAL_MASK))


def shard_totals(files: DataFrame) -> DataFrame:
    """shard_id, n_files, total_bytes, last_modified of a listing; repeated rows count once, null sizes as 0."""
    rows = files.select("shard_id", "name", "size", "modified_unix").distinct()
    return rows.groupBy("shard_id").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.max("modified_unix").alias("last_modified"))


def registry(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """shard_totals of the primary with state and has_replica: the shard with the greatest id takes writes, the others are sealed."""
    totals = shard_totals(primary)
    last = F.broadcast(totals.agg(F.max("shard_id").alias("last")))  # one row
    copies = replica.select("shard_id").distinct().withColumn("has_replica", F.lit(True))
    state = F.when(F.col("shard_id") == F.col("last"), "active").otherwise("sealed")
    return totals.join(last).withColumn("state", state).drop("last").join(copies, "shard_id", "left").withColumn("has_replica", F.coalesce("has_replica", F.lit(False)))


def read_route(state: Column, has_replica: Column) -> Column:
    """Where a shard is read: its replica once it is sealed and has one."""
    return F.when((state == "sealed") & F.coalesce(has_replica, F.lit(False)), "replica").otherwise("primary")


def seal_due(total_bytes: Column, threshold: Column) -> Column:
    """Whether a shard has reached the size at which it is sealed; null bytes have not."""
    return F.coalesce(total_bytes >= threshold, F.lit(False))

"""Upserts and merges as plans: the new state of a table from the old one and what comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_or_increment(existing: DataFrame, incoming: DataFrame, key: str, count: str, order: str, keep: list[str]) -> DataFrame:
    """key, keep, count, inserted: existing rows with their count raised by the incoming ones, and new keys with theirs.

    existing has one row a key. Of incoming rows of a new key, the first by order gives the kept columns. A null key is
    left out. Incoming rows are folded before the shuffle.
    """
    new = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.min_by(F.struct(*keep), order).alias("_new"))
    old = existing.where(F.col(key).isNotNull()).select(key, F.struct(*keep).alias("_old"), F.col(count).alias("_had"))
    both = old.join(new, key, "full")
    row = F.coalesce("_old", "_new")
    total = F.coalesce("_had", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return both.select(key, *(row[c].alias(c) for c in keep), total.alias(count), F.col("_old").isNull().alias("inserted"))


def replace_latest(existing: DataFrame, incoming: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key, columns: the incoming row of each key, the last by order, else the existing one (one row a key)."""
    new = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_new"))
    old = existing.where(F.col(key).isNotNull()).select(key, F.struct(*columns).alias("_old"))
    row = F.coalesce("_new", "_old")
    return old.join(new, key, "full").select(key, *(row[c].alias(c) for c in columns))


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing and those incoming rows whose key it lacks, one of each; both have the same columns."""
    fresh = incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh)


def fill_blank(existing: Column, given: Column) -> Column:
    """existing unless it is null or blank, else given."""
    return F.coalesce(F.nullif(F.btrim(existing), F.lit("")), given)


def guarded(condition: Column, new: Column, old: Column) -> Column:
    """new where the guard holds (null does not), else old."""
    return F.when(F.coalesce(condition, F.lit(False)), new).otherwise(old)

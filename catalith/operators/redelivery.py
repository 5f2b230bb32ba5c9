"""Messages that were delivered more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept_rows(df: DataFrame, key: str, row_id: str, arrival: Sequence[str]) -> DataFrame:
    """row_id of the row each key keeps: the first by arrival, then by row_id."""
    named = df.where(F.col(key).isNotNull() & F.col(row_id).isNotNull())
    if not arrival:
        return named.groupBy(F.col(key).alias("_key")).agg(F.min(row_id).alias("_row"))
    rank = F.struct(*(F.struct(F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"a{i}")) for i, c in enumerate([*arrival, row_id])))
    slim = named.select(F.col(key).alias("_key"), F.col(row_id).alias("_row"), rank.alias("_rank"))
    return slim.groupBy("_key").agg(F.min_by("_row", "_rank").alias("_row"))


def surplus_deliveries(df: DataFrame, key: str, row_id: str, arrival: Sequence[str] = ()) -> DataFrame:
    """The rows of df to be dropped so that exactly one of each key remains.

    Rows of a key are ranked by the columns of arrival (nulls last), then by row_id, which is unique; the first is
    kept, the others are returned, with all their columns. A row without a key or without a row_id repeats nothing and
    is never returned. An empty df gives no rows.

    The first of each key is found by an aggregate that is folded before the shuffle, and the rest by an anti-join on
    row_id: a key that holds a third of all rows weighs on no single task in either step.
    """
    kept = _kept_rows(df, key, row_id, arrival)
    named = df.where(F.col(key).isNotNull() & F.col(row_id).isNotNull())
    return named.join(kept, named[row_id] == kept["_row"], "left_anti")


def first_deliveries(df: DataFrame, key: str, row_id: str, arrival: Sequence[str] = ()) -> DataFrame:
    """The rows of df that remain, one of each key as in surplus_deliveries, and all rows without a key or row_id."""
    kept = _kept_rows(df, key, row_id, arrival)
    named = df.where(F.col(key).isNotNull() & F.col(row_id).isNotNull())
    rest = df.where(F.col(key).isNull() | F.col(row_id).isNull())
    return named.join(kept, named[row_id] == kept["_row"], "left_semi").unionByName(rest)


def accept_batch(stored: DataFrame, batch: DataFrame, key: str, row_id: str, arrival: Sequence[str] = ()) -> DataFrame:
    """The rows of a new batch to be stored: those whose key is not among the stored ones, one of each key.

    stored holds the identifiers accepted so far in a column named key. Only the identifiers are read from it, never
    the messages, and each only once. The batch is reduced to one row of each key first, so a hot key reaches the
    anti-join as one row. Rows of the batch without a key are all accepted.
    """
    first = first_deliveries(batch, key, row_id, arrival)
    seen = stored.select(F.col(key).alias("_seen")).distinct()
    return first.join(seen, first[key] == seen["_seen"], "left_anti")

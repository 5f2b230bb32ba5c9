"""Ordered analytics: ids, running offsets, valid prefixes, packing into segments, and signals carried forward.

Where an order runs through a whole table, rows fall into buckets of the order first; the buckets' sums are added up
in a small table, and only the rows of a bucket are sorted together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.functions.arrays import longs
from catalith.session import cut

#: Bytes around a record's payload, of a segment's footer, and the magic numbers of records.
RECORD_OVERHEAD, FOOTER = 12, 32
MAGIC = {"XML1": 0x584D4C31, "XML2": 0x584D4C32, "ZIP1": 0x5A495031, "ERR1": 0x45525231}


def _carried(rows: DataFrame, keys: list[str], bucket: str, inner: Column, fold, start, to: str) -> DataFrame:
    """rows with to: fold (an aggregate function) of inner over the buckets before a row's own, start in the first one."""
    sums = rows.groupBy(*keys, bucket).agg(fold(inner).alias("_in"))
    past = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    before = sums.withColumn(to, F.coalesce(fold("_in").over(past), start)).drop("_in")
    same = rows[bucket].eqNullSafe(before[bucket])
    for k in keys:
        same = same & rows[k].eqNullSafe(before[k])
    return rows.join(before, same).select(rows["*"], before[to])


def dense_ids(df: DataFrame, key: str, start: Column, to: str = "new_id", bits: int = 16) -> DataFrame:
    """df with to: start + 1, start + 2, ... in the order of key, a unique BIGINT; rows with a null key are left out.

    start is a column that is the same in all rows. A bucket holds 2 ** bits neighbouring keys, so at most that many rows.
    """
    rows = df.where(F.col(key).isNotNull()).withColumn("_bucket", F.shiftright(F.col(key).cast("long"), bits))
    placed = _carried(rows, [], "_bucket", F.lit(1), F.sum, F.lit(0), "_before")
    at = F.row_number().over(W.partitionBy("_bucket").orderBy(key))
    return placed.withColumn(to, start + F.col("_before") + at).drop("_bucket", "_before")


def running_offsets(df: DataFrame, segment: str, order: str, size: Column, to: str = "running_offset", bits: int = 16) -> DataFrame:
    """df with to: the bytes of the rows before in the same segment, by order, a unique BIGINT; a null size counts as 0.

    Rows of 2 ** bits neighbouring places are sorted together, however large the segment.
    """
    rows = df.withColumn("_bucket", F.shiftright(F.col(order).cast("long"), bits)).withColumn("_size", F.coalesce(size, F.lit(0)).cast("long"))
    placed = _carried(rows, [segment], "_bucket", F.col("_size"), F.sum, F.lit(0), "_before")
    past = W.partitionBy(segment, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn(to, F.col("_before") + F.coalesce(F.sum("_size").over(past), F.lit(0))).drop("_bucket", "_before", "_size")


def valid_prefix(df: DataFrame, segment: str, order: list[str], valid: Column, bits: int = 24) -> DataFrame:
    """df with kept: whether the row and all rows before it in its segment, by order, are valid (null is not).

    The first column of order is a BIGINT; rows whose values of it fall into the same 2 ** bits are sorted together.
    """
    rows = df.withColumn("_bucket", F.shiftright(F.col(order[0]).cast("long"), bits)).withColumn("_valid", F.coalesce(valid, F.lit(False)))
    placed = _carried(rows, [segment], "_bucket", F.col("_valid"), F.min, F.lit(True), "_before")
    w = W.partitionBy(segment, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.withColumn("kept", F.col("_before") & F.min("_valid").over(w)).drop("_bucket", "_before", "_valid")


def pack_segments(df: DataFrame, shard: str, order: str, size: str, most: int) -> DataFrame:
    """shard, order, segment INT, offset BIGINT: next-fit packing of each shard's records, in their order.

    A record opens the next segment if the current one holds anything and would, with a footer, grow beyond most bytes;
    so a record larger than that has a segment of its own. A null size counts as 0; rows with a null order are left
    out. A shard is sealed at a bound of its own, so the numbers of one shard (16 bytes a record) fit a task.
    """
    kinds = dict(df.dtypes)

    def run(table: pa.Table) -> pa.Table:
        at, _ = longs(table[order])
        sizes, _ = longs(table[size])
        by = np.argsort(at, kind="stable")
        ends = np.cumsum(sizes[by])
        segment, offset, first, number = np.empty(len(by), np.int32), np.empty(len(by), np.int64), 0, 0
        while first < len(by):
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + most - FOOTER, side="right")))
            segment[first:last] = number
            offset[first:last] = ends[first:last] - sizes[by][first:last] - base
            first, number = last, number + 1
        take = pa.array(by)
        return pa.table([table[shard].take(take), table[order].take(take), pa.array(segment), pa.array(offset)], names=[shard, order, "segment", "offset"])

    rows = df.where(F.col(order).isNotNull()).select(shard, order, size)
    return rows.groupBy(shard).applyInArrow(run, f"`{shard}` {kinds[shard]}, `{order}` {kinds[order]}, segment int, offset long")


def _cuts_in(most: int):
    """The places at which shards are full, from one table of at, h, g (128 bits of the key) and size, by at."""

    def run(table: pa.Table) -> pa.Table:
        at, h, g, size = (longs(table[c])[0] for c in ("at", "h", "g", "size"))
        by = np.argsort(at, kind="stable")
        at, size = at[by], size[by]
        _, key = np.unique(np.stack([h[by], g[by]], axis=1), axis=0, return_inverse=True)
        order = np.lexsort((np.arange(len(key)), key.ravel()))
        same = np.r_[False, key.ravel()[order][1:] == key.ravel()[order][:-1]]
        before = np.full(len(at), -1)  # the row before with the same key
        before[order[same]] = order[np.flatnonzero(same) - 1]
        cuts, first = [], 0
        step = 4096
        while first < len(at):
            held, last = 0, None
            for lo in range(first, len(at), step):
                hi = min(lo + step, len(at))
                bytes_ = held + np.cumsum(np.where(before[lo:hi] < first, size[lo:hi], 0))
                full = int(np.searchsorted(bytes_, most))
                if full < hi - lo:
                    last = lo + full
                    break
                held = int(bytes_[-1])
            if last is None:
                break
            cuts.append(int(at[last]))
            first = last + 1
        return pa.table({"cut": pa.array(cuts, pa.int64())})

    return run


def _next_cut(left: DataFrame, most: int, bits: int) -> int | None:
    """The place of the first cut, however many rows come before it: keys are folded before the shuffle, bytes added up by buckets."""
    first = left.groupBy("h", "g").agg(F.min("at").alias("at"), F.min_by("size", "at").alias("size"))
    first = first.withColumn("bucket", F.shiftright("at", bits))
    placed = _carried(first, [], "bucket", F.col("size"), F.sum, F.lit(0), "before")
    here = F.sum("size").over(W.partitionBy("bucket").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow))
    return placed.withColumn("bytes", F.col("before") + here).where(F.col("bytes") >= most).agg(F.min("at")).first()[0]


def shard_cuts(df: DataFrame, order: str, key: str, size: str, most: int, bits: int = 16, window_rows: int = 1_000_000) -> list[int]:
    """The last place of each full shard when the feed is taken in by order, a unique BIGINT.

    A shard takes in rows until the bytes of its different keys reach most, counting a key once a shard; the row that
    reaches it is its last. Where the next shard begins depends on where this one ends, so the feed is gone through in
    its order, a window of about window_rows rows at a time, in which one task finds all cuts from hashes and sizes; a
    shard that does not end within a window is cut by a distributed pass of its own. Only the places of the cuts come
    to the driver. Rows with a null order or key bring no bytes; null sizes count as 0.
    """
    slim = df.where(F.col(order).isNotNull() & F.col(key).isNotNull()).select(
        F.col(order).cast("long").alias("at"), F.xxhash64(key).alias("h"), F.xxhash64(F.lit(17), key).alias("g"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size")
    )
    slim = cut(slim)
    buckets = cut(slim.groupBy(F.shiftright("at", bits).alias("bucket")).agg(F.count("*").alias("n")))
    upto = F.sum("n").over(W.orderBy("bucket"))  # one row for 2 ** bits places
    cuts: list[int] = []
    while True:
        left = slim.where(F.col("at") > cuts[-1]) if cuts else slim
        ahead = buckets.where(F.col("bucket") >= (cuts[-1] >> bits)) if cuts else buckets
        end = ahead.withColumn("upto", upto).where((F.col("upto") <= window_rows) | (F.col("upto") == F.col("n"))).agg(F.max("bucket")).first()[0]
        if end is None:
            return cuts
        near = left.where(F.shiftright("at", bits) <= end).withColumn("all", F.lit(0))
        found = sorted(r[0] for r in near.groupBy("all").applyInArrow(_cuts_in(most), "cut long").collect())
        if not found:
            far = _next_cut(left, most, bits)
            if far is None:
                return cuts
            found = [far]
        cuts += found


def assign_shards(df: DataFrame, order: str, key: str, size: str, most: int, to: str = "shard") -> DataFrame:
    """df with to INT: the number of the shard each row falls into, by shard_cuts; null for a null order."""
    cuts = df.sparkSession.sparkContext.broadcast(np.array(shard_cuts(df, order, key, size, most), np.int64))  # 8 bytes a shard
    rest = df.drop(to)
    at = rest.columns.index(order)

    def run(batches):
        for batch in batches:
            place, null = longs(batch.column(at))
            shard = pa.array(np.searchsorted(cuts.value, place, side="left").astype(np.int32), mask=null)
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], names=[*batch.schema.names, to])

    return rest.mapInArrow(run, T.StructType([*rest.schema, T.StructField(to, T.IntegerType())]))


def carry_signal(df: DataFrame, keys: list[str], at: str, tie: str, signal: Column, period: str = "day") -> DataFrame:
    """df with held: the last signal that is not null, up to this row, of its keys by at and tie; null before the first.

    Each period's last signal is taken first and carried over the periods, so no task sorts more than the rows of one
    key and period.
    """
    rows = df.withColumn("_signal", signal).withColumn("_period", F.date_trunc(period, at))
    last = rows.where(F.col("_signal").isNotNull()).groupBy(*keys, "_period").agg(F.max_by("_signal", F.struct(at, tie)).alias("_last"))
    all_periods = rows.select(*keys, "_period").distinct().join(last, [*keys, "_period"], "left")
    past = W.partitionBy(*keys).orderBy("_period").rowsBetween(W.unboundedPreceding, -1)
    before = all_periods.withColumn("_before", F.last("_last", ignorenulls=True).over(past)).drop("_last")
    inside = W.partitionBy(*keys, "_period").orderBy(at, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = F.last("_signal", ignorenulls=True).over(inside)
    return rows.withColumn("_here", here).join(before, [*keys, "_period"]).withColumn("held", F.coalesce("_here", "_before")).drop("_here", "_before", "_signal", "_period")


def gate(free: Column, least: float, margin: float) -> Column:
    """The signal of a gate with hysteresis: true (blocked) below least, false from least + margin on, null between."""
    return F.when(free < least, True).when(free >= least + margin, False)

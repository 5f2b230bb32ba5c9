"""References to records that do not exist."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.arrays import fixed, found_at, longs, one, same_width
from catalith.session import cut

MISSING, DELETED, LATE = "missing", "deleted", "late"
_NEVER = np.iinfo(np.int64).min


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    """The bad ones of a range's references, held against the sorted parents of that range, one of each key."""
    keys, wanted = same_width(fixed(parents["key"]), fixed(refs["key"]))
    by = np.argsort(keys, kind="stable")
    flag = lambda name: np.asarray(one(parents[name])).astype(bool)[by] if len(parents) else np.zeros(0, bool)
    uniq, present, removed = keys[by], flag("lives"), flag("removed")
    (first, untimed), (last, undated) = ((x[by], null[by]) for x, null in (longs(parents["seen"]), longs(parents["gone"])))
    timed, last = ~untimed, np.where(undated, _NEVER, last)

    at, there = found_at(uniq, wanted)
    pick = lambda values: values[at] if len(values) else np.zeros(len(at), values.dtype)
    in_table, in_removals = there & pick(present), there & pick(removed)
    since, has_time, until = pick(first), pick(timed), pick(last)
    ref_at, ref_null = longs(refs["at"])
    missing = ~in_table & ~in_removals
    deleted = in_removals & (~in_table | ~(has_time & (since > until)))
    late = ~missing & ~deleted & has_time & ~ref_null & (since > ref_at)
    state = np.select([missing, deleted, late], [MISSING, DELETED, LATE], "")
    bad = pa.array(state != "")
    return pa.table(
        {
            "ref": one(refs["ref"]).filter(bad),
            "record_id": one(refs["record_id"]).filter(bad),
            "at": one(refs["at"]).filter(bad),
            "state": pa.array(state[state != ""].tolist(), pa.string()),
        }
    )


def _range_of(key: Column, bits: int) -> Column:
    """The range a key falls into: equal slices of its hash, which are as even for sparse numbers as for digests."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def digest_ref(key: Column) -> Column:
    """A reference key of a digest as of functions.hashes.hash_key."""
    return F.when(key.isNotNull(), F.concat(F.lit(b"d"), key))


def number_ref(number: Column) -> Column:
    """A reference key of a numeric id."""
    return F.when(number.isNotNull(), F.concat(F.lit(b"n"), F.encode(number.cast("string"), "utf-8")))


def bad_references(refs: DataFrame, parents: DataFrame, removals: DataFrame, ref_keys: DataFrame | None = None, range_rows: int = 200_000) -> DataFrame:
    """The references whose target is missing, deleted or late: ref, record_id, at, state.

    refs: ref STRING (which referring column), record_id BIGINT, key BINARY, at TIMESTAMP (when the referring record
    came). parents: key BINARY, seen TIMESTAMP. removals: key BINARY, gone TIMESTAMP. Keys are made by digest_ref or
    number_ref; one of null is no reference, no parent and no removal. Other columns play no part. ref_keys: the keys
    of refs alone, where they can be had more cheaply than through refs; they are only counted.

    missing: the key is neither among the parents nor removed. deleted: it is removed, and not among the parents or
    not first seen there after its last removal (a null time is not after). late: otherwise, if first seen after at;
    a null time is never late. Of several rows of a parent its first time holds, of several removals the last. Repeated
    references come out once. Empty tables are allowed.

    Parents and removals are folded to one row a key before they are dealt out, so one with a third of all rows weighs
    as much as any other. They are cut into ranges of their keys' hashes and held as one sorted array each; the
    references of a range are looked up in it by binary search, a batch at a time. The references of a range of more
    than range_rows of them (or one in 100,000 of all, if that is more) are dealt to several copies of that range's
    parents, so a key that holds a third of all references does not meet in one task, nor do copies of one reference.
    There are at most 100,000 such ranges; their list is broadcast, and nothing but two counts comes to the driver.
    """
    parents, removals = parents.where(F.col("key").isNotNull()), removals.where(F.col("key").isNotNull())
    bits = max(3, math.ceil(math.log2(max(1, parents.count()) / (range_rows // 2) + 1)) + 1)
    slim = refs.where(F.col("key").isNotNull()).select("ref", "record_id", "key", "at", _range_of(F.col("key"), bits).alias("range"))
    sizes = cut((refs if ref_keys is None else ref_keys).where(F.col("key").isNotNull()).groupBy(_range_of(F.col("key"), bits).alias("range")).count())
    full = max(range_rows, (sizes.agg(F.sum("count")).first()[0] or 0) // 100_000)
    parts = F.broadcast(sizes.where(F.col("count") > full).select("range", F.ceil(F.col("count") / full).cast("int").alias("parts")))
    time = lambda c: F.col(c).cast("timestamp").alias(c)
    none = lambda c: F.lit(None).cast("timestamp").alias(c)
    known = parents.select("key", time("seen"), none("gone"), F.lit(True).alias("lives"), F.lit(False).alias("removed")).unionByName(
        removals.select("key", none("seen"), time("gone"), F.lit(False).alias("lives"), F.lit(True).alias("removed"))
    )
    known = known.groupBy("key").agg(F.min("seen").alias("seen"), F.max("gone").alias("gone"), F.max("lives").alias("lives"), F.max("removed").alias("removed")).withColumn("range", _range_of(F.col("key"), bits))
    spread = F.pmod(F.xxhash64("record_id", "at", F.spark_partition_id()), F.coalesce("parts", F.lit(1)))
    dealt = slim.join(parts, "range", "left").withColumn("part", spread).drop("parts")
    copied = known.join(parts, "range", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("parts")
    found = dealt.groupBy("range", "part").cogroup(copied.groupBy("range", "part")).applyInArrow(_probe, "ref string, record_id long, at timestamp, state string")
    return found.distinct()

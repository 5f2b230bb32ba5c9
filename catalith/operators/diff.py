"""Differences between two copies of a table, cell by cell."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.arrays import one


def key_codes(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
    """int64 codes of two sides' key columns: equal codes stand for equal keys, null being equal to null."""
    n = len(one(left[0]))
    codes = np.zeros(n + len(one(right[0])), np.int64)
    for a, b in zip(left, right):
        both = pa.concat_arrays([one(a), one(b)]).dictionary_encode(null_encoding="mask")
        col = np.asarray(pc.fill_null(both.indices.cast(pa.int64()), -1)) + 1
        # brought back to 0..n after each column, so that many columns do not overflow
        codes = np.unique(codes * (len(both.dictionary) + 1) + col, return_inverse=True)[1]
    return codes[:n], codes[n:]


def unequal(left, right) -> np.ndarray:
    """Where two arrays differ; null differs from any value, not from null."""
    same = pc.fill_null(pc.equal(left, right), False)
    both_null = pc.and_(left.is_null(), right.is_null())
    return ~np.asarray(pc.or_(same, both_null))


def _differ(keys: list[str], fields: list[str], names: tuple[str, str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = key_codes([left[k] for k in keys], [right[k] for k in keys])
        order = np.argsort(b, kind="stable")
        at = np.searchsorted(b[order], a)
        hit = np.zeros(len(a), bool)
        if len(b):
            at = np.minimum(at, len(b) - 1)
            hit = b[order][at] == a
        at = order[at] if len(b) else at
        only_right = np.ones(len(b), bool)
        only_right[at[hit]] = False
        parts = []

        def add(side: pa.Table, rows: np.ndarray, diff: str, mine=None, theirs=None) -> None:
            take = pa.array(rows)
            nulls = pa.nulls(len(rows), pa.string())
            parts.append(
                pa.table(
                    [one(side[k]).take(take) for k in keys]
                    + [pa.array([diff] * len(rows), pa.string()), nulls if mine is None else mine, nulls if theirs is None else theirs],
                    names=[*keys, "diff", f"{names[0]}_value", f"{names[1]}_value"],
                )
            )

        add(left, np.flatnonzero(~hit), f"only_{names[0]}")
        add(right, np.flatnonzero(only_right), f"only_{names[1]}")
        mine, theirs = np.flatnonzero(hit), at[hit]
        for field in fields:
            x, y = one(left[field]).take(pa.array(mine)), one(right[field]).take(pa.array(theirs))
            mask = unequal(x, y)
            add(left, mine[mask], field, x.filter(pa.array(mask)), y.filter(pa.array(mask)))
        return pa.concat_tables(parts)

    return run


def diff_cells(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: dict[str, Column],
    names: tuple[str, str] = ("left", "right"),
    bucket_rows: int = 100_000,
) -> DataFrame:
    """The differences of two copies of a table: keys, diff, <left>_value, <right>_value (texts).

    keys name the columns that identify a row; fields gives, by name, the expressions to compare. diff is
    only_<left> or only_<right> for a key that one side lacks, else the name of a field whose values differ, one row
    for each such field. A null key part equals null; a null value differs from any value, not from null. Repeated rows
    count once; of several different rows of a key on one side, the one with the least values (nulls first, in the
    order of fields) stands for it. Other columns, whatever their names, play no part. Empty sides are allowed.

    Copies are folded before the shuffle, so a key that holds much of a table costs a bucket no more than any other
    key. Both sides are cut into buckets by the hash of the key, about bucket_rows keys each, and each pair of buckets
    is compared as Arrow tables.
    """
    rows = max(left.count(), right.count())  # from the Parquet footers where the sides are plain scans
    buckets = max(1, -(-rows // bucket_rows))
    buckets = max(buckets, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    inner = [f"_k{i}" for i in range(len(keys))]

    def fold(side: DataFrame) -> DataFrame:
        values = F.struct(*(e.cast("string").alias(f) for f, e in fields.items()))
        slim = side.select(*(F.col(k).alias(i) for k, i in zip(keys, inner)), values.alias("_v"))
        least = slim.groupBy(*inner).agg(F.min("_v").alias("_v"))
        return least.select(F.pmod(F.xxhash64(*inner), F.lit(buckets)).alias("_bucket"), *(F.col(i).alias(k) for k, i in zip(keys, inner)), "_v.*")

    a, b = fold(left), fold(right)
    kinds = dict(a.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["diff string", f"{names[0]}_value string", f"{names[1]}_value string"])
    return a.groupBy("_bucket").cogroup(b.groupBy("_bucket")).applyInArrow(_differ(list(keys), list(fields), names), schema)

"""An approximate gate before exact lookups: Bloom filters by partitions of hashed keys."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.arrays import longs

_U = np.uint64
_SCHEMA = "part long, part_bits int, n_keys long, n_hashes int, bits binary"


def _places(keys: np.ndarray, n_bits: int, n_hashes: int) -> np.ndarray:
    """The bits of each key, one column a hash function (double hashing)."""
    a, b = keys * _U(0x9E3779B97F4A7C15), keys * _U(0xC2B2AE3D27D4EB4F) | _U(1)
    a ^= a >> _U(32)
    return (a[:, None] + np.arange(n_hashes, dtype=_U) * (b ^ b >> _U(29) | _U(1))[:, None]) % _U(n_bits)


def _part(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def bloom_index(known: DataFrame, key: Column, rate: float = 0.001, part_keys: int = 1_000_000) -> DataFrame:
    """part, part_bits, n_keys, n_hashes, bits: Bloom filters of the keys (BIGINT, 64 bits of an identifier; null is none).

    rate bounds the share of other keys taken for known ones. Keys are cut by their top bits into partitions of about
    part_keys; a partition has a filter of its own, 1.44 log2(1 / rate) bits a key (1.8 MB at 1,000,000 keys and the
    default rate), so no filter outgrows a task however many keys there are. Keys are made distinct first.
    """
    keys = known.select(key.alias("key")).where(F.col("key").isNotNull()).distinct()
    part_bits = max(1, (-(-known.count() // part_keys) - 1).bit_length())
    per_key = -math.log(rate) / math.log(2) ** 2
    n_hashes = max(1, round(per_key * math.log(2)))

    def build(table: pa.Table) -> pa.Table:
        mine = longs(table["key"])[0].view(_U)
        n_bits = max(64, math.ceil(per_key * len(mine)))
        bits = np.zeros(-(-n_bits // 64) * 64, bool)
        bits[_places(mine, len(bits), n_hashes).ravel().astype(np.int64)] = True
        return pa.table({"part": table["part"][:1], "part_bits": pa.array([part_bits], pa.int32()), "n_keys": [len(mine)], "n_hashes": pa.array([n_hashes], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return keys.withColumn("part", _part(F.col("key"), part_bits)).groupBy("part").applyInArrow(build, _SCHEMA)


def might_contain(rows: DataFrame, key: str, index: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """rows with maybe BOOLEAN: false if the key, a BIGINT column, is certainly none of the index; false for a null key.

    The rows of a partition meet its filter, and nothing else is sent to them; an index without rows knows no key. A
    partition's rows are probed chunk at a time; rows should hold a key once.
    """
    first = index.select("part_bits").first()
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    if first is None:
        return rows.withColumn("maybe", F.lit(False))

    def probe(mine: pa.Table, known: pa.Table) -> pa.Table:
        mine = mine.drop_columns(["_part"])
        keys, null = longs(mine[key])
        hit = np.zeros(len(keys), bool)
        if len(known) and len(keys):
            bits = np.unpackbits(np.frombuffer(known["bits"][0].as_py(), np.uint8), bitorder="little")
            for at in range(0, len(keys), chunk):
                places = _places(keys[at : at + chunk].view(_U), len(bits), known["n_hashes"][0].as_py())
                hit[at : at + chunk] = bits[places.astype(np.int64)].all(axis=1)
        return mine.append_column("maybe", pa.array(hit & ~null))

    dealt = rows.withColumn("_part", F.coalesce(_part(F.col(key), first[0]), F.lit(-1).cast("long")))
    return dealt.groupBy("_part").cogroup(index.groupBy("part")).applyInArrow(probe, f"{kinds}, maybe boolean")

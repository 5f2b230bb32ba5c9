import random

from pyspark.sql import functions as F

from catalith.functions.hashes import hash_digits
from catalith.operators.diff import diff_cells

SCHEMA = "shard_id int, name string, size long, sha256 string, diff string"
FIELDS = {"size": lambda: F.col("size"), "sha256": lambda: hash_digits(F.col("sha256"))}


def run(spark, a, b, **more):
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    cells = diff_cells(left, right, ["shard_id", "name"], {n: f() for n, f in FIELDS.items()}, ("a", "b"), **more)
    return sorted(((r["shard_id"], r["name"], r["diff"]) for r in cells.collect()), key=repr)


H = "ab" * 32


def test_each_kind_of_difference(spark):
    a = [(1, "same", 5, H, "x"), (1, "size", 5, H, None), (1, "hash", 5, H, None), (1, "gone", 1, H, None), (1, "null", None, None, None), (1, "null2", None, H, None)]
    b = [(1, "same", 5, "\\x" + H.upper() + " ", "y"), (1, "size", 6, H, None), (1, "hash", 5, "cd" * 32, None), (2, "new", 1, H, None), (1, "null", None, None, None), (1, "null2", 3, None, None)]
    assert run(spark, a, b) == sorted([(1, "size", "size"), (1, "hash", "sha256"), (1, "gone", "only_a"), (2, "new", "only_b"), (1, "null2", "size"), (1, "null2", "sha256")], key=repr)


def test_repeats_null_keys_and_small_buckets(spark):
    a = [(None, "x", 1, H, None)] * 50 + [(1, None, 1, H, None), (1, "t", 2, H, None), (1, "t", 1, H, None)]
    b = [(None, "x", 1, H, None), (1, None, 2, H, None), (1, "t", 1, H, None)]
    assert run(spark, a, b, bucket_rows=1) == [(1, None, "size")]


def test_empty_sides(spark):
    row = (1, "x", 1, H, None)
    assert run(spark, [], []) == []
    assert run(spark, [row], []) == [(1, "x", "only_a")]
    assert run(spark, [], [row]) == [(1, "x", "only_b")]


def test_values_shown(spark):
    a, b = spark.createDataFrame([(1, "x", 1, H, None)], SCHEMA), spark.createDataFrame([(1, "x", 2, H, None)], SCHEMA)
    (row,) = diff_cells(a, b, ["shard_id", "name"], {"size": F.col("size")}).collect()
    assert (row["left_value"], row["right_value"]) == ("1", "2")


def test_against_brute_force(spark):
    rnd = random.Random(3)
    side = lambda: {(rnd.randrange(4), f"n{rnd.randrange(60)}"): (rnd.choice([None, 1, 2]), rnd.choice([None, H, "cd" * 32])) for _ in range(150)}
    a, b = side(), side()
    want = [(*k, "only_a") for k in a.keys() - b.keys()] + [(*k, "only_b") for k in b.keys() - a.keys()]
    for k in a.keys() & b.keys():
        want += [(*k, f) for i, f in enumerate(("size", "sha256")) if a[k][i] != b[k][i]]
    rows = lambda s: [(*k, *v, None) for k, v in s.items()]
    assert run(spark, rows(a), rows(b), bucket_rows=10) == sorted(want, key=repr)

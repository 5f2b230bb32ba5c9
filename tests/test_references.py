import datetime as dt
import random

from pyspark.sql import functions as F

from catalith.functions.hashes import hash_key
from catalith.operators.references import bad_references, digest_ref, number_ref

T = lambda n: None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)


def run(spark, refs, parents, removals, key=lambda c: digest_ref(hash_key(c)), kind="string", **more):
    make = lambda rows, cols: spark.createDataFrame(rows, cols).withColumn("key", key(F.col("k"))).drop("k")
    r = make([("r", i, k, T(t), "extra") for i, k, t in refs], f"ref string, record_id long, k {kind}, at timestamp, seen string")
    p = make([(k, T(t), 1) for k, t in parents], f"k {kind}, seen timestamp, at int")
    g = make([(k, T(t)) for k, t in removals], f"k {kind}, gone timestamp")
    return sorted((x["record_id"], x["state"]) for x in bad_references(r, p, g, **more).collect())


def brute(refs, parents, removals):
    out = set()
    for i, k, t in refs:
        if k is None:
            continue
        there = [x for h, x in parents if h == k]
        gone = [x for h, x in removals if h == k]
        since = min((x for x in there if x is not None), default=None)
        until = max((x for x in gone if x is not None), default=None)
        if not there and not gone:
            out.add((i, "missing"))
        elif gone and (not there or not (since is not None and (until is None or since > until))):
            out.add((i, "deleted"))
        elif since is not None and t is not None and since > t:
            out.add((i, "late"))
    return sorted(out)


def test_states_of_numbers(spark):
    refs = [(1, 5, 1), (2, 6, 1), (3, 7, 1), (4, 8, 1), (5, 0, 1), (6, -3, None), (7, None, 1), (8, 9, 3), (9, 10, 1), (10, 9, None)]
    parents = [(5, 0), (6, 2), (7, 0), (8, 6), (9, 5), (9, 5), (-3, 1), (10, None), (None, 1)]
    removals = [(7, 1), (8, 1), (11, 1), (0, 1), (10, 0), (None, 1)]
    want = brute(refs, parents, removals)
    assert want == [(2, "late"), (3, "deleted"), (4, "late"), (5, "deleted"), (8, "late"), (9, "deleted")]
    assert run(spark, refs, parents, removals, number_ref, "long") == want


def test_texts_of_one_hash_are_one_key(spark):
    h = "0" * 63 + "a"
    assert run(spark, [(1, "\\x" + h.upper(), 1), (2, h[1:], 1), (3, " ", 1), (4, h + "b" * 2, 1)], [(f" {h} ", 0)], []) == [(2, "missing"), (4, "missing")]


def test_empty_tables(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [(1, "ab" * 32, 1)], [], []) == [(1, "missing")]
    assert run(spark, [(1, "ab" * 32, 1)], [], [("ab" * 32, None)]) == [(1, "deleted")]


def test_a_hot_key_is_dealt_out(spark):
    rnd = random.Random(5)
    keys = [f"{rnd.getrandbits(256):064x}" for _ in range(40)]
    refs = [(i, keys[0] if i % 3 == 0 else rnd.choice([*keys, None]), rnd.choice([None, *range(10)])) for i in range(900)]
    refs += refs[:50]
    parents = [(k, rnd.choice([None, *range(10)])) for k in keys[:30]]
    removals = [(k, rnd.randrange(10)) for k in keys[20:35]]
    assert run(spark, refs, parents, removals, range_rows=20) == brute(refs, parents, removals)


def test_a_hot_parent_and_sparse_numbers(spark):
    rnd = random.Random(6)
    keys = [rnd.getrandbits(64) - 2**63 for _ in range(300)]
    refs = [(i, rnd.choice(keys), rnd.choice([None, *range(10)])) for i in range(600)] + [(10_000, keys[0], 1)] * 300
    parents = [(keys[0] if i % 3 == 0 else rnd.choice(keys[:200]), rnd.choice([None, *range(10)])) for i in range(900)]
    removals = [(keys[0] if i % 3 == 0 else rnd.choice(keys[150:250]), rnd.choice([None, *range(10)])) for i in range(300)]
    assert run(spark, refs, parents, removals, number_ref, "long", range_rows=50) == sorted(set(brute(refs, parents, removals)))

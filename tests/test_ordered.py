import datetime as dt
import random

from pyspark.sql import functions as F

from catalith.operators import merge as M
from catalith.operators import metrics as X
from catalith.operators import ordered as O


def test_dense_ids_over_many_buckets(spark):
    keys = random.Random(1).sample(range(-5000, 5000), 300)
    df = spark.createDataFrame([(k, "z") for k in keys] + [(None, "z")], "k long, _bucket string")
    got = {r["k"]: r["new_id"] for r in O.dense_ids(df.drop("_bucket"), "k", F.lit(100), bits=3).collect()}
    assert got == {k: 101 + i for i, k in enumerate(sorted(keys))}


def test_running_offsets(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 1, None]), rnd.choice([None, 3, 5])) for i in range(200)]
    sums, want = {}, {}
    for i, s, n in rows:
        want[i] = sums.get(s, 0)
        sums[s] = want[i] + (n or 0)
    df = spark.createDataFrame(rows, "i long, s int, n long")
    assert {r["i"]: r["running_offset"] for r in O.running_offsets(df, "s", "i", F.col("n"), bits=3).collect()} == want


def test_valid_prefix(spark):
    df = spark.createDataFrame([(0, i, i != 150) for i in range(300)] + [(1, 5, None), (1, 9, True), (2, 1, True)], "s int, o long, ok boolean")
    kept = {(r["s"], r["o"]) for r in O.valid_prefix(df, "s", ["o"], F.col("ok"), bits=4).where("kept").collect()}
    assert kept == {(0, i) for i in range(150)} | {(2, 1)}


def test_next_fit_packing(spark):
    rnd = random.Random(4)
    rows = [(s, i, rnd.choice([None, 0, 10, 40, 90, 300])) for s in (1, 2) for i in range(80)]
    want = {}
    for s in (1, 2):
        number = at = 0
        for _, i, n in (r for r in rows if r[0] == s):
            if at > 0 and at + (n or 0) + 32 > 200:
                number, at = number + 1, 0
            want[s, i] = (number, at)
            at += n or 0
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "s int, i long, n long")
    assert {(r["s"], r["i"]): (r["segment"], r["offset"]) for r in O.pack_segments(df, "s", "i", "n", 200).collect()} == want


def test_signal_is_carried_over_periods(spark):
    day = dt.datetime(2025, 1, 1)
    free = [3, 7, 12, 7, 6, None, 4, 8, 9, 20]
    df = spark.createDataFrame([(1, day + dt.timedelta(hours=10 * i), i, f) for i, f in enumerate(free)] + [(2, day, 0, 7)], "k int, at timestamp, i int, free int")
    got = {(r["k"], r["i"]): r["held"] for r in O.carry_signal(df, ["k"], "at", "i", O.gate(F.col("free"), 5, 5)).collect()}
    assert [got[1, i] for i in range(10)] == [True, True, False, False, False, False, True, True, True, False] and got[2, 0] is None


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 2, 0)], "k string, v int, n long")
    new = spark.createDataFrame([("a", 9, 1), ("c", 7, 3), ("c", 8, 2), (None, 1, 1)], "k string, v int, at int")
    assert sorted(map(tuple, M.insert_or_increment(old, new, "k", "n", "at", ["v"]).collect())) == [("a", 1, 6, False), ("b", 2, 0, False), ("c", 8, 2, True)]
    assert sorted(map(tuple, M.replace_latest(old, new, "k", "at", ["v"]).collect())) == [("a", 9), ("b", 2), ("c", 7)]
    assert sorted(map(tuple, M.insert_ignore(old.select("k", "v"), new.select("k", "v").where("k = 'a' or v = 7"), ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 7)]
    filled = spark.createDataFrame([(" ", "x"), (None, "x"), ("y", "x")], "a string, b string").select(M.fill_blank(F.col("a"), F.col("b")))
    assert [r[0] for r in filled.collect()] == ["x", "x", "y"]


def test_histogram(spark):
    df = spark.createDataFrame([("r", v) for v in (0.5, 1.5, 2.0, 50.0, None)] + [("none", None)], "route string, v double")
    counts = {(r["route"], r["le"]): r["n"] for r in X.bucket_counts(df, ["route"], "v", (1.0, 2.0)).collect()}
    assert counts == {("r", 1.0): 1, ("r", 2.0): 3, ("r", float("inf")): 4}
    assert {r["route"]: r["quantile"] for r in X.histogram_quantile(df, ["route"], "v", 0.5, (1.0, 2.0)).collect()} == {"r": 1.5}
    assert {r["route"]: r["quantile"] for r in X.histogram_quantile(df, ["route"], "v", 0.95, (1.0, 2.0)).collect()} == {"r": 2.0}


def test_shards_are_cut_by_new_bytes(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice(["a", "b", "c", None, str(rnd.randrange(50))]), rnd.choice([None, 5, 20])) for i in range(200)]
    sizes = {}
    rows = [(i, k, sizes.setdefault(k, n)) for i, k, n in rows]
    want, number, have, met = {}, 0, 0, set()
    for i, k, n in rows:
        want[i] = number
        if k is not None and k not in met:
            met.add(k)
            have += n or 0
            if have >= 100:
                number, have, met = number + 1, 0, set()
    df = spark.createDataFrame(rows[::-1] + [(None, "a", 5)], "i long, k string, n int")
    got = {r["i"]: r["shard"] for r in O.assign_shards(df, "i", "k", "n", 100).collect()}
    assert number > 1 and got == {**want, None: None}
    assert O.assign_shards(df.limit(0), "i", "k", "n", 100).count() == 0


def test_windows_of_any_size_cut_alike(spark):
    rnd = random.Random(8)
    rows = [(i, "a" if rnd.random() < 0.5 else str(rnd.randrange(80)), 7) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, k string, n int")
    want = O.shard_cuts(df, "i", "k", "n", 60)
    assert len(want) > 5 and O.shard_cuts(df, "i", "k", "n", 60, bits=3, window_rows=20) == want and O.shard_cuts(df, "i", "k", "n", 60, bits=5, window_rows=100) == want

import random

from pyspark.sql import functions as F

from catalith.operators.bloom import bloom_index, might_contain


def test_no_known_key_is_missed_and_the_rate_holds(spark):
    rnd = random.Random(1)
    keys = [rnd.getrandbits(64) - 2**63 for _ in range(6000)]
    known = spark.createDataFrame([(k, 1) for k in keys[:3000] + keys[:500]] + [(None, 1)], "k long, part int")
    index = bloom_index(known, F.col("k"), 0.01, part_keys=500)
    assert index.count() == 8 and sum(r["n_keys"] for r in index.collect()) == 3000
    rows = spark.createDataFrame([(i, k, "x") for i, k in enumerate([*keys, None])], "id int, k long, part string")
    got = {r["id"]: r["maybe"] for r in might_contain(rows, "k", index, chunk=100).collect()}
    assert len(got) == 6001 and all(got[i] for i in range(3000)) and got[6000] is False
    assert sum(got[i] for i in range(3000, 6000)) < 3000 * 0.02


def test_nothing(spark):
    none = spark.createDataFrame([], "k long")
    rows = spark.createDataFrame([(1,), (None,)], "k long")
    assert [r["maybe"] for r in might_contain(rows, "k", bloom_index(none, F.col("k"))).collect()] == [False, False]
    assert might_contain(none, "k", bloom_index(rows, F.col("k"))).count() == 0

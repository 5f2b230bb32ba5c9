import random

from catalith.operators.redelivery import accept_batch, first_deliveries, surplus_deliveries

SCHEMA = "line_no long, package_id long, at long, _row string, _key string"


def rows(spark, data):
    return spark.createDataFrame([(a, b, c, "x", "y") for a, b, c in data], SCHEMA)


def test_first_by_line_remains(spark):
    df = rows(spark, [(3, 1, 0), (1, 1, 9), (2, 2, 0), (4, None, 0), (5, None, 0)])
    assert [r["line_no"] for r in surplus_deliveries(df, "package_id", "line_no").collect()] == [3]
    assert sorted(r["line_no"] for r in first_deliveries(df, "package_id", "line_no").collect()) == [1, 2, 4, 5]


def test_arrival_before_line_and_nulls_last(spark):
    df = rows(spark, [(1, 1, 5), (2, 1, 3), (3, 1, 3), (4, 2, None), (5, 2, 7)])
    assert sorted(r["line_no"] for r in surplus_deliveries(df, "package_id", "line_no", ["at"]).collect()) == [1, 3, 4]


def test_hot_key_and_brute_force(spark):
    rnd = random.Random(1)
    data = [(i, 7 if i % 3 == 0 else rnd.randrange(40), 0) for i in range(500)]
    rnd.shuffle(data)
    first = {}
    for line, key, _ in data:
        first[key] = min(line, first.get(key, line))
    assert {r["line_no"] for r in surplus_deliveries(rows(spark, data), "package_id", "line_no").collect()} == {x for x, k, _ in data} - set(first.values())


def test_batches(spark):
    stored = rows(spark, [(1, 1, 0), (2, 1, 0), (3, None, 0)])
    batch = rows(spark, [(4, 1, 0), (5, 2, 0), (6, 2, 0), (7, None, 0)])
    assert sorted(r["line_no"] for r in accept_batch(stored, batch, "package_id", "line_no").collect()) == [5, 7]
    assert accept_batch(stored, batch.limit(0), "package_id", "line_no").count() == 0
    assert surplus_deliveries(stored.limit(0), "package_id", "line_no").count() == 0

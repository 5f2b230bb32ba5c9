import random

from catalith.operators.skew import salted_left_join


def test_a_hot_key_copies_and_nulls(spark):
    rnd = random.Random(1)
    many = [(rnd.choice([None, *range(50)]), i, 0) for i in range(2000)] + [(7, 1, 1)] * 15_000 + [(None, 2, 2)] * 5_000
    one = [(k, f"n{k}") for k in range(40)] + [(99, "alone")]
    names = dict(one)
    m = spark.createDataFrame(many, "id int, n int, _x int")
    got = salted_left_join(m, spark.createDataFrame(one, "id int, name string"), "id", len(many))
    assert got.columns == ["id", "n", "_x", "name"]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((*r, names.get(r[0])) for r in many), key=key)
    assert salted_left_join(m.limit(0), m.select("id").distinct(), "id", 0).count() == 0

from catalith.sources.buckets import BucketStore


def test_rows_are_put_found_replaced_and_taken_out(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "kv"), "k string, v int", "k", 16)
    frame = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    asked = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "wanted string")
    assert store.get(asked).count() == 0 and store.opened == 0
    store.put(frame(("a", 1), ("b", 2), (None, 3)), 0)
    store.put(frame(("a", 4)), 1)
    store.put(frame(("a", 5)), 1)
    assert sorted(r["v"] for r in store.get(asked).collect()) == [1, 5] and store.opened <= 3
    assert [r["v"] for r in store.get(asked, before=1).collect()] == [1]
    store.put(frame(("c", 6)).limit(0), 2)
    store.truncate()
    assert store.get(asked).count() == 0

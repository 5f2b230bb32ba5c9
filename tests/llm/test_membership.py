import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catalith.llm.membership import EliasFano, key_index, probe_index, seen_before, seen_report


@settings(max_examples=150, deadline=None)
@given(st.integers(8, 63), st.sets(st.integers(0, 2**63 - 1), max_size=200), st.lists(st.integers(0, 2**63 - 1), max_size=50))
def test_codes_against_sets(bits, members, probes):
    cut = lambda xs: [x % 2**bits for x in xs]
    members, probes = sorted(set(cut(members))), cut(probes) + cut(members)
    code = EliasFano.encode(np.array(members, np.uint64), bits)
    assert code.decode().tolist() == members
    assert code.contains(np.array(probes, np.uint64)).tolist() == [p in set(members) for p in probes]
    new = np.array(sorted(set(probes) - set(members)), np.uint64)
    assert code.merge(new).decode().tolist() == sorted({*members, *probes})


def test_dense_and_sparse_codes_take_few_bits():
    for bits, n in ((20, 500_000), (64 - 4, 100_000)):
        values = np.unique(np.random.default_rng(1).integers(0, 2**bits, n).astype(np.uint64))
        code = EliasFano.encode(values, bits)
        assert 8 * code.nbytes / len(values) < 4 + bits - np.log2(len(values)) + 1 and code.contains(values).all()


def run(spark, known, rows):
    k = spark.createDataFrame([(x, 1) for x in known], "key binary, part int")
    r = spark.createDataFrame([(i, x, 1) for i, x in rows], "entry_no long, key binary, fp int")
    return k, r, sorted(x["row_no"] for x in seen_before(k, r, "key", "entry_no", part_keys=50).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_with_a_hot_key(spark, seed):
    rnd = random.Random(seed)
    keys = [rnd.randbytes(33) for _ in range(300)]
    known = [rnd.choice([*keys[:100], None]) for _ in range(200)]
    rows = [(i, keys[200] if i % 3 == 0 else rnd.choice([*keys, None])) for i in range(3000)]
    want, seen = [], set(known) - {None}
    for i, k in rows:
        if k is not None and k in seen:
            want.append(i)
        seen.add(k)
    rnd.shuffle(rows)
    k, r, got = run(spark, known, rows)
    assert got == want
    (report,) = seen_report(k, r, "key", "entry_no", part_keys=50).collect()
    assert report["found"] == len(want) and 0 <= report["wrong_bound"] < 1e-9 and report["keys"] == len(seen - {None})


def test_a_hot_known_key(spark):
    assert run(spark, [b"a"] * 3000 + [b"b"], [(1, b"a"), (2, b"b"), (3, b"c")])[2] == [1, 2]


def test_empty_sides_and_nulls(spark):
    assert run(spark, [], [])[2] == [] and run(spark, [b"a"], [])[2] == []
    assert run(spark, [], [(1, b"a"), (2, b"a"), (3, None), (4, None), (None, b"a")])[2] == [2]
    assert run(spark, [b"a"], [(5, b"a")])[2] == [5]
    (report,) = seen_report(*run(spark, [], [])[:2], "key", "entry_no").collect()
    assert report["keys"] == 0 and report["wrong_rate"] is None


def test_a_stored_index_takes_further_batches(spark):
    rnd = random.Random(8)
    keys = [rnd.randbytes(33) for _ in range(200)]
    rows = [(i, rnd.choice([*keys, None])) for i in range(900)]
    make = lambda part: spark.createDataFrame(part, "entry_no long, key binary")
    known = spark.createDataFrame([(k,) for k in keys[:50]], "key binary")
    index = key_index(known, make(rows[:300]), "key", "entry_no", part_keys=50)
    got = [r["row_no"] for r in seen_before(known, make(rows[:300]), "key", "entry_no").collect()]
    for part in (rows[300:600], rows[600:]):
        found, index = probe_index(index, make(part), "key", "entry_no", part_keys=20)
        got += [r["row_no"] for r in found.collect()]
    assert sorted(got) == [r["row_no"] for r in seen_before(known, make(rows), "key", "entry_no").orderBy("row_no").collect()]
    assert index.count() == index.select("part").distinct().count() and sum(r["keys"] for r in index.collect()) == len({k for _, k in rows if k} | set(keys[:50]))
    assert index.agg({"keys": "max"}).first()[0] <= 60 and index.select("part_bits").distinct().count() == 1

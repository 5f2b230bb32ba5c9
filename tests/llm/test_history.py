import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.llm.history import HistoryIndex, _entries_of, _Parts, _parts_of, _probes_of, candidates, history_duplicates, hot_items, incremental_duplicates, near_sets, ordered_sets, segment_entries, segment_probes, verified


def brute(packages, batches, members):
    batch = {}
    for p, b in batches:
        batch[p] = min(b, batch.get(p, b))
    keys, sets = {}, {}
    for i, k in packages:
        keys[i] = k
    for p, x in members:
        if x is not None and p in keys:
            sets.setdefault(p, set()).add(x)
    out = set()
    for p in keys:
        if p not in batch:
            continue
        hits = []
        for q in keys:
            if q == p or (batch.get(q, 0), q if q in batch else 0) >= (batch[p], p):
                continue
            a, b = sets.get(p), sets.get(q)
            if (keys[p] is not None and keys[p] == keys[q]) or (a and b and 10 * len(a & b) >= 7 * len(a | b)):
                hits.append(q)
        if hits:
            out.add((min(hits), p))
    return out


def run(spark, packages, batches, members):
    p = spark.createDataFrame([(i, k, 0) for i, k in packages], "id long, key binary, batch_no int")
    b = spark.createDataFrame([(i, n, None) for i, n in batches], "package_id long, batch_no int, items string")
    m = spark.createDataFrame([(i, x, 1) for i, x in members], "package_id long, item long, sid int")
    return {tuple(r) for r in history_duplicates(p, b, m, len(members)).collect()}


def frame(spark, sets, hot=(), first=0):
    """sets as sid, items, hot: hot items last, the others in any one order."""
    order = lambda s: sorted(s - set(hot), key=lambda x: (x * 7919) % 1_000_003) + sorted(s & set(hot))
    rows = [((i, 0), order(set(s)), len(set(s) & set(hot))) for i, s in enumerate(sets, first)]
    return spark.createDataFrame(rows, "sid struct<h:bigint,g:bigint>, items array<bigint>, hot int")


def pairs(df):
    return {(r["probe"]["h"], r["stored"]["h"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    packages, members, made = [], [], []
    for i in range(160):
        if made and rnd.random() < 0.6:
            s = set(rnd.choice(made))
            for _ in range(rnd.choice([0, 0, 1, 2, 5, 9])):
                s.discard(rnd.choice(sorted(s))) if s and rnd.random() < 0.5 else s.add(rnd.randrange(10**6))
        else:
            s = {rnd.randrange(10**6) for _ in range(rnd.choice([0, 1, 2, 3, 4, 7, 10, 20, 33]))} | ({7} if rnd.random() < 0.6 else set())
        made.append(s)
        packages.append((i, rnd.choice([None, b"x", rnd.randbytes(2)]) if rnd.random() < 0.1 else rnd.randbytes(8)))
        members += [(i, x) for x in s] + [(i, None)] * rnd.choice([0, 1])
    batches = [(i, rnd.randrange(1, 5)) for i in rnd.sample(range(160), 70)] + [(999, 1)]
    again = packages[:20]
    members += members[:40] + [(5000, 7)]
    assert run(spark, packages + again, batches + batches[:5], members) == brute(packages, batches, members)


@pytest.mark.parametrize("n_hot", [0, 2, 40])
def test_every_near_pair_is_found(spark, n_hot):
    rnd = random.Random(9)
    sets, want, hot = [], set(), rnd.sample(range(10**6), n_hot)
    some = lambda n: [rnd.choice(hot) if hot and rnd.random() < 0.5 else rnd.randrange(10**6) for _ in range(n)]
    for _ in range(90):
        a = some(rnd.choice([rnd.randrange(1, 10), rnd.randrange(1, 60), rnd.randrange(60, 400)]))
        b = list(a)
        for _ in range(rnd.randrange(0, 2 + len(a) // 3)):
            b.pop(rnd.randrange(len(b))) if len(b) > 1 and rnd.random() < 0.5 else b.extend(some(1))
        sets += [set(a), set(b)]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and 10 * len(a & b) >= 7 * len(a | b):
                want.add((i, j))
    df = frame(spark, sets, hot)
    assert len(want) > 60 and pairs(near_sets(df, df)) == want


def test_an_index_grows_by_appending(spark):
    sets = [{1, 2, 3, 4}, {1, 2, 3, 5}, {9}, {1, 2, 3, 4, 6}]
    old, new = frame(spark, sets[:2]), frame(spark, sets[2:], first=2)
    grown = segment_entries(old).unionByName(segment_entries(new))
    assert pairs(verified(candidates(grown, segment_probes(new)), old.unionByName(new), new)) == {(3, 0)}


def test_common_items_bring_no_candidates(spark):
    for common, own in (({7, 8}, 3), ({7, 8}, 1), ({7}, 1), ({7, 8, 9}, 2), (set(range(10)), 5), (set(range(10)), 30), (set(range(10)), 200)):
        n = 400 if own < 100 else 60
        df = frame(spark, [common | {10**6 + i * 1000 + j for j in range(own)} for i in range(n)], common)
        assert candidates(segment_entries(df), segment_probes(df)).count() == 0


def test_probes_grow_with_the_size(spark):
    count = lambda n: segment_probes(frame(spark, [set(range(n))])).count()
    assert count(4000) < 3 * count(2000) and count(4000) < 10 * 4000


def test_ties_copies_and_nothing(spark):
    packages = [(i, None) for i in range(10)] + [(None, b"k")]
    members = [(i, 7) for i in range(10)]
    assert run(spark, packages, [(i, 1 + i % 2) for i in range(4, 10)], members) == {(0, i) for i in range(4, 10)}
    assert run(spark, packages, [(i, 1) for i in range(10)], members) == {(0, i) for i in range(1, 10)}
    assert run(spark, [(5, b"a"), (3, b"a")], [(3, 1)], []) == {(5, 3)}
    assert run(spark, [], [], []) == set() and run(spark, packages, [], members) == set() and run(spark, packages, [(1, 1), (None, 1), (2, None)], []) == set()


def test_hot_items_come_last(spark):
    rows = [(i, 7) for i in range(50)] + [(i, 8) for i in range(40)] + [(i, 100 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "o long, x long")
    sets = ordered_sets(df, "o", F.col("x"), hot_items(df, F.col("x"), len(rows), hot_parts=10))
    assert {(tuple(r["items"]), r["hot"]) for r in sets.where("o = 3").collect()} == {((103, 8, 7), 2)}


def test_batch_by_batch_equals_all_at_once(spark, tmp_path):
    rnd = random.Random(11)
    made, packages, members = [], [], []
    for i in range(60):
        s = set(rnd.choice(made)) if made and rnd.random() < 0.6 else {rnd.randrange(10**6) for _ in range(rnd.choice([0, 1, 4, 9, 20]))} | {7}
        for _ in range(rnd.choice([0, 0, 1, 3])):
            s.add(rnd.randrange(10**6))
        made.append(s)
        packages.append((i, rnd.choice([None, b"x", rnd.randbytes(8)])))
        members += [(i, x) for x in s] + [(i, None)]
    batch = {i: rnd.randrange(4) for i in range(60)}  # 0 is history
    want = brute(packages, [(i, b) for i, b in batch.items() if b], members)
    index, got = HistoryIndex(spark, str(tmp_path / "index"), 8), set()
    for number in (0, 1, 2, 2, 3):
        mine = {i for i in batch if batch[i] == number}
        p = spark.createDataFrame([x for x in packages if x[0] in mine], "id long, key binary")
        m = spark.createDataFrame([x for x in members if x[0] in mine], "package_id long, item long")
        found = {tuple(r) for r in index.check_and_append(number, p, m).collect()}
        got |= found if number else set()
    assert got == want
    p, m = spark.createDataFrame(packages, "id long, key binary"), spark.createDataFrame(members, "package_id long, item long")
    b = spark.createDataFrame([(i, n) for i, n in batch.items() if n], "package_id long, batch_no int")
    assert {tuple(r) for r in incremental_duplicates(p, b, m, str(tmp_path / "other"), 8).collect()} == want


def test_a_small_batch_opens_few_buckets(spark, tmp_path):
    index = HistoryIndex(spark, str(tmp_path / "index"), 64)
    p = spark.createDataFrame([(i, bytes([i % 256, i // 256])) for i in range(300)], "id long, key binary")
    m = spark.createDataFrame([(i, i * 100 + j) for i in range(300) for j in range(4)], "package_id long, item long")
    index.check_and_append(0, p, m)
    one = spark.createDataFrame([(900, b"new")], "id long, key binary"), spark.createDataFrame([(900, 700 + j) for j in range(5)], "package_id long, item long")
    assert {tuple(r) for r in index.check_and_append(1, *one).collect()} == {(7, 900)}
    assert index.segments.opened <= 12 and index.sets.opened == 1 and index.ids.opened <= 3


def test_every_near_pair_meets_in_a_segment():
    rnd = random.Random(5)

    def parts(items, hot, n):
        return _Parts(np.array(items, np.int64), np.array([len(items)]), np.array([hot]), np.array([n]))

    met = 0
    for _ in range(6000):
        n, common, q = rnd.choice([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 20, 31, 32, 33, 64, 90]), rnd.choice([0, 1, 2, 3, 5, 20]), rnd.random()
        pick = lambda: rnd.randrange(1, 1 + common) if common and rnd.random() < q else rnd.randrange(1000, 10**6)  # noqa: B023, E731
        a = {pick() for _ in range(n)}
        b = set(a)
        for _ in range(rnd.randrange(0, 2 + len(a) // 3)):
            b.discard(rnd.choice(sorted(b))) if rnd.random() < 0.5 and len(b) > 1 else b.add(pick())
        if 10 * len(a & b) < 7 * len(a | b):
            continue
        met += 1
        a, b = (sorted(s, key=lambda x: (x < 1000, x * 7919 % 1_000_003)) for s in (a, b))
        many = int(_parts_of(np.array([len(a)]))[0])
        stored, new = parts(a, sum(x < 1000 for x in a), many), parts(b, sum(x < 1000 for x in b), many)
        part, shift, start, length = _entries_of(stored)
        to, at, size = _probes_of(new)
        probes = {}
        for key, b_n, place in zip(new.keys(to, at, size).tolist(), new.n[to].tolist(), at.tolist()):
            probes.setdefault(key, []).append((b_n, place))
        entries = zip(stored.keys(part, start, length).tolist(), stored.n[part].tolist(), shift.tolist(), start.tolist())
        assert any(10 * x >= 7 * y and 10 * y >= 7 * x and abs(p - s) <= k for key, x, k, s in entries for y, p in probes.get(key, ()))
    assert met > 3000

import math
import random

import numpy as np
from pyspark.sql import functions as F

from catalith.llm.distinct import ALL, BOTH, FIRST, SECOND, add_elements, distinct_sketches, estimates, exact_counts, gamma_quantile, measured, merge_sketches


def test_gamma_quantiles():
    assert math.isclose(gamma_quantile(1, 0.5), math.log(2), rel_tol=1e-9)
    draws = np.random.default_rng(1).gamma(256, size=200_000)
    for p in (0.025, 0.5, 0.975):
        assert abs(np.quantile(draws, p) - gamma_quantile(256, p)) < 0.4


def test_registers_are_exponential_minima():
    m, out = 64, []
    for trial in range(300):
        registers = np.full((1, m), np.inf, np.float32)
        add_elements(registers, np.zeros(20, np.int64), np.random.default_rng(trial).integers(0, 2**63, 20).astype(np.uint64))
        out.append(registers[0])
    values = np.concatenate(out).astype(float) * 20
    assert abs(values.mean() - 1) < 0.03 and abs(values.var() - 1) < 0.1


def test_order_and_repeats_do_not_matter():
    e = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    g = np.arange(5000) % 3
    one, two = np.full((3, 128), np.inf, np.float32), np.full((3, 128), np.inf, np.float32)
    add_elements(one, g, e)
    by = np.random.default_rng(3).permutation(np.r_[np.arange(5000), np.arange(100)])
    for part in np.array_split(by, 7):
        add_elements(two, g[part], e[part])
    assert (one == two).all()


def sketches(spark, rows, **more):
    df = spark.createDataFrame(rows, "a long, b int, key long")
    return distinct_sketches(df, F.col("a"), F.col("b"), F.col("key"), m=128, **more)


def counts(sk):
    return {(r["level"], r["a"] if r["level"] & 1 else "*", r["b"] if r["level"] & 2 else "*"): r for r in estimates(sk, m=128).collect()}


def test_against_exact_counts(spark):
    rnd = random.Random(1)
    rows = [(0 if i % 3 == 0 else rnd.choice([1, 2, None]), rnd.choice([None, 5, 6]), rnd.choice([None, rnd.getrandbits(62)])) for i in range(9000)]
    rows += rows[:3000]
    got, exact = counts(sketches(spark, rows).repartition(3)), {}
    for a, b, k in rows:
        if k is not None:
            for key in ((ALL, "*", "*"), (FIRST, a, "*"), (SECOND, "*", b), (BOTH, a, b)):
                exact.setdefault(key, set()).add(k)
    assert set(got) == set(exact)
    inside = [got[k]["low"] <= len(v) <= got[k]["high"] for k, v in exact.items()]
    # at most three standard errors off, and one interval in twenty misses
    assert sum(inside) >= len(inside) - 2 and all(abs(got[k]["n"] / len(v) - 1) < 3 / math.sqrt(126) for k, v in exact.items())
    # however often a task passes on what it holds
    for more in ({"flush_rows": 300}, {"flush_rows": 300, "held_most": 2}):
        assert counts(sketches(spark, rows, **more)) == got
    frame = spark.createDataFrame(rows, "a long, b int, key long")
    for r in measured(estimates(sketches(spark, rows), 128), exact_counts(frame, F.col("a"), F.col("b"), F.col("key"))).collect():
        assert r["n_exact"] == len(exact[r["level"], r["a"] if r["level"] & 1 else "*", r["b"] if r["level"] & 2 else "*"])


def test_small_groups_are_exact_and_empty_ones_absent(spark):
    got = counts(sketches(spark, [(1, 1, 5), (1, 1, 5), (1, None, 6), (2, 1, None)]))
    assert {k: (r["n"], r["exact"]) for k, r in got.items()} == {(ALL, "*", "*"): (2, True), (FIRST, 1, "*"): (2, True), (SECOND, "*", 1): (1, True), (SECOND, "*", None): (1, True), (BOTH, 1, 1): (1, True), (BOTH, 1, None): (1, True)}
    assert counts(sketches(spark, [])) == {}


def test_merging_days_gives_the_sketch_of_the_whole(spark):
    rnd = random.Random(4)
    rows = [(i % 40, i % 2, rnd.randrange(3000)) for i in range(8000)]
    days = sketches(spark, rows, levels=(FIRST,))
    weeks = merge_sketches(days, F.lit(FIRST), F.floor(F.col("a") / 20), F.lit(0), m=128)
    direct = sketches(spark, [(a // 20, b, k) for a, b, k in rows], levels=(FIRST,))
    pick = lambda sk: {r["a"]: (r["few"], r["registers"]) for r in sk.collect()}
    assert pick(weeks) == pick(direct) and len(pick(weeks)) == 2

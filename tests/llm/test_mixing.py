import random

import numpy as np
from pyspark.sql import functions as F

from catalith.llm.mixing import Mix, largest_total, mix_report, rake


def test_raking_meets_margins_within_caps():
    rnd = np.random.default_rng(1)
    tokens = rnd.integers(1, 100, 24).astype(float)
    a, b = np.arange(24) % 3, np.arange(24) // 3 % 4
    weight = rake(tokens, [(a, np.array([50.0, 100.0, 60.0])), (b, np.full(4, 52.5))], np.full(24, 5.0))
    assert np.allclose(np.bincount(a, weight * tokens), [50, 100, 60]) and np.allclose(np.bincount(b, weight * tokens), 52.5, rtol=0.01)
    capped = rake(np.array([10.0, 10.0, 10.0]), [(np.array([0, 0, 1]), np.array([15.0, 90.0]))], np.array([0.5, 3.0, 2.0]))
    assert np.allclose(capped[2], 2) and np.allclose(capped[:2].sum(), 1.5) and capped[0] <= 0.5
    assert len(rake(np.empty(0), [(np.empty(0, np.int64), np.empty(0))], np.empty(0))) == 0


def test_largest_total():
    assert largest_total({"a": 100, "b": 10}, {"a": 0.5, "b": 0.4, "none": 0.1}, {"a": 1, "b": 2, "none": 1}) == 10 * 2 * 0.9 / 0.4
    assert largest_total({}, {"a": 1.0}, {"a": 1}) == 0


DOCS = "doc_id long, text string, source string, lang string, tags array<string>, weight int, copies string"
TARGETS = "source string, target_share double, max_repeats int"


def mix(spark, docs, targets, **more):
    return made_and_drawn(spark, docs, targets, **more)[1:]


def made_and_drawn(spark, docs, targets, **more):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS)
    t = spark.createDataFrame(targets, TARGETS)
    made = Mix(df, t, "doc_id", "text", "source", F.col("lang"), F.try_element_at("tags", F.lit(1)), **more)
    drawn = made.drawn()
    return made, drawn, {r["source"]: r for r in mix_report(drawn, t).collect()}


def test_shares_are_reached(spark):
    rnd = random.Random(1)
    docs = [(i, " word" * rnd.choice([1, 5, 30, 200]), "big" if i % 3 else rnd.choice(["mid", "small", None, "other"]), rnd.choice(["en", "de", None]), rnd.choice([None, [], ["x"], ["y", "x"]])) for i in range(1500)]
    docs += [(5000, None, "big", "en", None), (5001, "", "big", "en", None), (None, " word", "big", "en", None)]
    targets = [("big", 0.5, 1), ("mid", 0.3, 4), ("small", 0.19, 4), ("absent", 0.01, 3), (None, 0.5, 1), ("big", 0.5, 1)]
    drawn, report = mix(spark, docs, targets)
    for source, share in (("big", 0.5), ("mid", 0.3), ("small", 0.19)):
        assert abs(report[source]["actual_share"] - share / 0.99) < 0.005
    assert report["absent"]["n_tokens"] == 0 and set(report) == {"big", "mid", "small", "absent"}
    rows = drawn.collect()
    assert len({r["doc"] for r in rows}) == len(rows) and all(1 <= r["copies"] <= (1 if r["source"] == "big" else 4) for r in rows)
    assert sorted(map(tuple, mix(spark, docs[::-1], targets)[0].collect())) == sorted(map(tuple, rows))


def test_a_total_that_a_source_cannot_fill(spark):
    docs = [(i, " word" * 10, s, "en", None) for i, s in enumerate(["a"] * 100 + ["b"] * 5)]
    made, _, report = made_and_drawn(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], total_tokens=1000)
    assert {r["source"]: r["most_tokens"] for r in made.available().collect()} == {"a": 1000, "b": 100}
    assert report["a"]["n_tokens"] == 500 and report["b"]["n_tokens"] == 100 and report["b"]["most_uses"] == 2


def test_every_language_and_topic_counts(spark):
    rnd = random.Random(3)
    docs = [(i, " word" * rnd.randrange(1, 20), rnd.choice("aab"), rnd.choice(["en", "de", None, f"l{i % 9}"]), rnd.choice([None, ["t"], [f"t{i % 70}"]])) for i in range(3000)]
    targets = [("a", 0.3, 1), ("b", 0.7, 3)]
    here, drawn, report = made_and_drawn(spark, docs, targets)
    tables, _, other = made_and_drawn(spark, docs, targets, driver_cells=0)
    weights = lambda made: {(r["source"], r["lang"], r["topic"]): r["weight"] for r in made.cells.collect()}
    a, b = weights(here), weights(tables)
    assert set(a) == set(b) and len(a) > 400 and all(abs(a[k] - b[k]) < 0.001 for k in a)
    assert abs(report["a"]["actual_share"] - 0.3) < 0.003 and abs(other["a"]["actual_share"] - 0.3) < 0.003
    rows = here.margins().collect()
    assert {m: sum(r["margin"] == m for r in rows) for m in ("source", "lang", "topic")} == {"source": 2, "lang": len({d[3] for d in docs}), "topic": len({d[4][0] if d[4] else None for d in docs})}
    for r in rows:
        assert abs(r["planned_share"] - r["target_share"]) < (0.0001 if r["margin"] == "source" else 0.01) and abs(r["actual_share"] - r["planned_share"]) < 0.02
    assert {r["copies"] for r in drawn.collect()} <= {1, 2, 3}


def test_documents_keep_their_weight_on_average(spark):
    # over many keys (the draws hash them), documents of one cell and any size are drawn as often as the cell's weight says
    sizes = [1] * 50 + [20] * 10 + [300]
    docs = [(i * 1000 + j, " word" * n, "a", "en", None) for i in range(40) for j, n in enumerate(sizes)]
    docs += [(10**6 + i, " word" * 10, "b", "en", None) for i in range(4000)]
    _, drawn, _ = made_and_drawn(spark, docs, [("a", 0.2, 1), ("b", 0.8, 1)], total_tokens=30_000)
    used = {r["doc"] for r in drawn.collect()}
    weight = 6000 / (40 * (50 + 200 + 300))
    for n in (1, 20, 300):
        mine = [d for d, t, s, *_ in docs if s == "a" and len(t) == 5 * n]
        assert abs(len([d for d in mine if d in used]) / len(mine) - weight) < 0.05 + 1.5 / len(mine)


def test_nothing_to_draw(spark):
    for docs, targets in (([], [("a", 1.0, 1)]), ([(1, "x", "a", "en", None)], []), ([(1, "x", "a", "en", None)], [("a", None, 1), ("b", 0.5, None)])):
        drawn, report = mix(spark, docs, targets)
        assert drawn.count() == 0 and all(r["n_tokens"] == 0 and r["actual_share"] == 0 for r in report.values())

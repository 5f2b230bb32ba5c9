import random
from itertools import combinations

import numpy as np
import pytest

from catalith.llm.spans import SharedSpans, _places_of, anchors, components, pairs_within, runs


def brute(docs, span):
    places = {}
    for i, t in docs:
        if i is not None and t is not None:
            for p in range(len(t) - span + 1):
                places.setdefault(t[p : p + span], set()).add(i)
    pairs = {c for s in places.values() for c in combinations(sorted(s), 2)}
    cover = {}
    for i, t in docs:
        if i is None or t is None or len(t) < span:
            continue
        mark = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if len(places[t[p : p + span]]) > 1:
                mark[p : p + span] = b"\1" * span
        cover[i] = sum(mark)
    return pairs, cover


def run(spark, docs, span, gram, most_kinds=32, chunk=1_000_000):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, gram int")
    s = SharedSpans(df, "doc_id", "text", span, gram, most_kinds, chunk)
    rows = [tuple(r) for r in s.pairs().collect()]
    assert len(rows) == len(set(rows))
    return set(rows), {r["doc"]: r["n_shared"] for r in s.coverage().collect()}


@pytest.mark.parametrize("most_kinds", [32, 2])
@pytest.mark.parametrize("seed,alphabet", [(1, "abcdefgh é漢🙂"), (2, "ab"), (3, "abcdefghijklmnop \n")])
def test_against_brute_force(spark, seed, alphabet, most_kinds):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    pool, docs = [text(rnd.randrange(15, 60)) for _ in range(8)], []
    for i in range(70):
        parts = [text(rnd.randrange(0, 30)), rnd.choice(pool)[rnd.randrange(0, 8) :], text(rnd.randrange(0, 20)), rnd.choice(["", *pool])]
        docs.append((i, "".join(parts)))
    docs += [(100 + i, docs[i][1]) for i in range(5)] + [(200, None), (None, docs[0][1]), (201, ""), (202, "x" * 19), (203, pool[0] * 300)]
    assert run(spark, docs, 20, 8, most_kinds, 25 if most_kinds == 2 else 1_000_000) == brute(docs, 20)


def test_bounds_of_the_span(spark):
    rnd = random.Random(5)
    t = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    same, less = t(160), t(159)
    docs = [(1, t(50) + same), (2, same + t(70)), (3, t(20) + less + "#"), (4, "!" + less + t(9)), (5, same)]
    assert run(spark, docs, 160, 48) == ({(1, 2), (1, 5), (2, 5)}, {1: 160, 2: 160, 3: 0, 4: 0, 5: 160})


@pytest.mark.parametrize("most_kinds", [32, 2])
def test_a_span_repeated_within_one_text_only(spark, most_kinds):
    rnd = random.Random(7)
    t = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    own, common = t(40), t(40)
    docs = [(1, own + t(30) + own + t(30) + common), (2, t(9) + common), (3, common + t(5) + common)]
    # parts of the repeated span, shorter than a span, stand in other texts too
    docs += [(10 + i, f"{t(25)}#{own[i : i + 19]}#{t(25)}") for i in range(22)]
    want = brute(docs, 20)
    assert want[1][1] == 40 and run(spark, docs, 20, 8, most_kinds) == want
    docs.append((4, t(20) + own[:25] + t(30) + own[:25]))
    assert run(spark, docs, 20, 8, most_kinds) == brute(docs, 20)


def test_runs_periods_and_a_hot_text(spark):
    docs = [(50 + i, f"{x}{'abc' * 40}{x * 3}{'=' * n}{x}") for i, (x, n) in enumerate((("q", 90), ("r", 19), ("s", 20), ("t", 21)))]
    docs += [(60 + i, (line + "\n") * n) for i, (line, n) in enumerate((("-" * 30, 20), ("-" * 30, 3), ("- " * 25, 9), ("-" * 19, 40), ("x, " * 9, 8)))]
    docs += [(i, "a" * n) for i, n in enumerate((5, 30, 31, 500))] + [(10, "ab" * 200), (11, "ba" * 100)] + [(20 + i, "the same text in very many rows") for i in range(12)]
    assert run(spark, docs, 20, 8) == brute(docs, 20)


def test_repetitive_text_gives_few_places(spark):
    for text in ("=" * 40_000, "=-" * 20_000, ("-" * 80 + "\n") * 500):
        s = SharedSpans(spark.createDataFrame([(1, text + "x"), (2, "y" + text)], "doc_id long, text string"), "doc_id", "text")
        assert s.places().count() < 1500
        assert {tuple(r) for r in s.pairs().collect()} == {(1, 2)}
        assert {r["doc"]: r["n_shared"] for r in s.coverage().collect()} == {1: len(text), 2: len(text)}


def test_runs_name_all_places():
    rnd = random.Random(3)
    text = "".join(rnd.choice(("=" * rnd.randrange(1, 40), "ab" * rnd.randrange(1, 30), "abc", "x" + "-" * 25, "q")) for _ in range(60))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    of, place, hashes = anchors(codes, np.array([len(text)]), 8, 13)
    first, run = runs(of, place, hashes)
    got = []
    for p, r, h in zip(place[first].tolist(), run.tolist(), hashes[first]):
        for a, b in _places_of(p, r, 8, 12):
            step = max(1, r >> 32)
            got += [(q, h) for q in range(a, b + 1, step)]
            around = {(text[max(0, q - 12) : q], text[q : q + 20]) for q in range(a, b + 1, step)}
            assert len(around) == 1
    assert sorted(got) == sorted(zip(place.tolist(), hashes)) and len(first) < len(place)


def test_pairs_within_groups():
    group, side = np.array([0, 0, 0, 1, 1, 1, 1, 2, 3, 3]), np.array([2, 2, 2, 0, 0, 1, 1, 2, 1, 1])
    assert list(zip(*(x.tolist() for x in pairs_within(group, side)))) == [(0, 1), (0, 2), (1, 2), (3, 5), (3, 6), (4, 5), (4, 6)]
    assert len(pairs_within(group[:0], side[:0])[0]) == 0


def test_groups_of_several_parts(spark):
    # 1,300 texts that share a stretch and nothing else, each pair of them found once
    shared = "0123456789" * 3
    df = spark.range(1300).selectExpr("id AS doc_id", f"concat(md5(string(id)), '{shared}', md5(string(-id))) AS text")
    assert SharedSpans(df, "doc_id", "text", 30, 12).pairs().count() == 1300 * 1299 // 2


def test_nothing(spark):
    assert run(spark, [], 20, 8) == (set(), {}) and run(spark, [(1, None), (2, "")], 20, 8) == (set(), {})


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    nodes = rnd.sample(range(1000), 120)
    links = {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(70)} | set(zip(nodes[:40], nodes[1:40]))
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    n = spark.createDataFrame([(f"k{x}", x) for x in nodes], "k string, least long")
    e = spark.createDataFrame([(f"k{a}", f"k{b}") for x in links for a, b in (x, x[::-1]) if a != b], "a string, b string")
    assert {r["k"]: r["least"] for r in components(n, e, "k", "least").collect()} == {f"k{x}": y for x, y in label.items()}
    assert components(n.limit(0), e.limit(0), "k", "least").count() == 0


def test_clusters(spark):
    p, q, r = ("one shared stretch of text", "another stretch that is shared", "stands alone in its document")
    docs = [(5, p), (3, p + q), (9, "x" + q), (7, r), (2, r), (1, "a third one without company")]
    s = SharedSpans(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 20, 8)
    assert {tuple(x) for x in s.clusters().collect()} == {(5, 3, 1, False), (3, 3, 1, True), (9, 3, 1, False), (7, 2, 0, False), (2, 2, 0, True), (1, 1, 0, True)}


@pytest.mark.parametrize("most_kinds", [32, 2])
def test_clusters_are_the_components_of_the_pairs(spark, most_kinds):
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("abcdefghijk") for _ in range(n))
    pool = [text(24) for _ in range(30)]
    docs = [(i, text(rnd.randrange(0, 25)) + rnd.choice([*pool, text(30)]) + text(rnd.randrange(0, 25)) + rnd.choice(["", "", rnd.choice(pool)])) for i in range(90)]
    docs += [(200 + i, docs[i][1]) for i in range(5)]
    pairs, label = brute(docs, 20)[0], {i: i for i, t in docs if len(t) >= 20}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    s = SharedSpans(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 20, 8, most_kinds)
    rows = s.clusters().collect()
    assert {r["doc"]: r["cluster"] for r in rows} == label
    holders = {}
    for _, t in docs:
        for p in range(len(t) - 19):
            holders.setdefault(t[p : p + 20], set()).add(t)
    most = {i: max(len(holders[t[p : p + 20]]) for p in range(len(t) - 19)) - 1 for i, t in docs if len(t) >= 20}
    assert {r["doc"]: r["n_links"] for r in rows} == most


def test_a_footer_of_all_texts_brings_few_links(spark):
    rnd = random.Random(2)
    footer = "".join(rnd.choice("abcdefghij ") for _ in range(300))
    df = spark.range(3000).selectExpr("id AS doc_id", "concat(md5(string(id)), md5(string(-id)), md5(concat(id, 'x')), md5(concat(id, 'y')), '" + footer + "') AS text")
    s = SharedSpans(df, "doc_id", "text")
    links, _ = s._stars()
    assert links.count() < 8 * 3000
    rows = s.clusters().collect()
    assert {r["cluster"] for r in rows} == {0} and {r["n_links"] for r in rows} == {2999} and sum(r["kept"] for r in rows) == 1

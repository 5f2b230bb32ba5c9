import datetime as dt

from pyspark.sql import functions as F

from catalith.functions.hashes import hash_digits, hash_key
from catalith.operators import catalog as C
from catalith.operators import payloads as P
from catalith.operators import shards as S
from tests_support import BLOBS, FILES, H, PACKAGES

NOW = dt.datetime(2025, 1, 1)


def packages(spark, rows):
    return spark.createDataFrame([(i, s, NOW, h, "zip", m, None, None, c, None) for i, s, h, m, c in rows], PACKAGES)


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def test_hash_digits(spark):
    texts = [H[10], " " + H[10].upper() + " ", "\\x" + H[10], "sha256:" + H[10], "", "  ", None, H[10][:-1], "0xAB"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", hash_digits(F.col("t")).alias("d"), hash_key(F.col("t")).alias("k"))
    got = {r["i"]: (r["d"], r["k"]) for r in df.collect()}
    assert [got[i][0] for i in range(8)] == [H[10]] * 4 + [None] * 3 + [H[10][:-1]]
    assert len({bytes(got[i][1]) for i in range(4)}) == 1 and got[7][1] != got[0][1] and got[6][1] is None


def test_a_repeat_and_its_statistics(spark):
    p = packages(spark, [(1, 1, H[1], "single", 1), (2, 1, H[1].upper(), "single", 1), (2, 1, H[1].upper(), "single", 1)])
    f = files(spark, [(1, 1, H[1], "original", None, None), (2, 2, H[1], "original", None, None)])
    (row,) = C.supplier_stats(C.ingest_counters(p, f)).collect()
    assert (row["total_packages"], row["total_refs"], row["duplicate_refs"], row["dedup_ratio"]) == (2, 2, 1, 0.5)


def test_clone_of_another_supplier(spark):
    p = packages(spark, [(1, 1, H[1], "single", 1), (2, 2, H[1], "single", 1), (3, 3, None, "single", 1), (4, 3, " ", "single", 1)])
    got = {r["supplier_id"]: r["duplicate_refs"] for r in C.supplier_stats(C.ingest_counters(p, files(spark, []))).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_members_shared_by_archives(spark):
    f = files(spark, [(1, 1, H[1], "member", "a", 0), (2, 1, H[2], "member", "b", 1), (3, 2, H[1], "member", "c", 0), (4, 2, None, "member", "d", 1), (5, 2, H[3], "member", "../e", 2)])
    assert {r["blob_hash"]: r["cnt"] for r in C.reference_counts(f).collect()} == {H[1]: 2, H[2]: 1, H[3]: 1}
    assert sorted((r["id"], r["position"]) for r in C.member_sequence(f).collect()) == [(1, 0), (2, 1), (3, 0), (4, 1)]


def test_early_clone_is_repaired(spark):
    p = packages(spark, [(1, 1, H[0], "zip_with_members", 3), (2, 1, H[0], "raw_large", 1)])
    f = files(spark, [(1, 1, H[0], "original", None, None), (2, 1, H[1], "member", None, None), (3, 1, H[2], "member", "b", 1), (4, 2, H[0], "original", None, None), (5, 2, H[2].upper(), "member", "b", 1)])
    assert [tuple(r) for r in C.missing_clone_files(p, f).collect()] == [(2, "member", -1, "", H[1])]


def test_totals_and_kpis(spark):
    b = spark.createDataFrame([(H[1], 600, 300, 0, 0, 4, NOW), (H[2], 400, 0, 0, 0, 0, NOW), (H[2], 400, 0, 0, 0, 0, NOW), (None, 9, 9, 0, 0, 9, NOW)], BLOBS)
    (t,) = C.flat_totals(b).collect()
    assert tuple(t) == (1000, 700, 2400)
    known = spark.createDataFrame([(1000, 400, 2500)], "logical_bytes long, stored_bytes long, referenced_bytes long")
    (k,) = C.kpis(known, F.lit(800)).collect()
    assert (k["compression_ratio"], round(k["savings_percent"], 9), k["efficiency"]) == (2.5, 60.0, 3.125)
    (z,) = C.kpis(C.flat_totals(b.limit(0)), F.lit(0)).collect()
    assert (z["logical_bytes"], z["compression_ratio"], z["savings_percent"], z["efficiency"]) == (0, 1.0, 0.0, 1.0)


def test_manifest_of_a_package_without_files(spark):
    b = spark.createDataFrame([(H[1], 5, 5, 0, 0, 1, NOW)], BLOBS)
    m = C.manifests(packages(spark, [(1, 1, H[0], "single", 1), (2, 1, H[0], "single", 1)]), files(spark, [(9, 1, H[1], "original", None, None), (8, 1, H[2], "member", None, 0)]), b)
    got = {r["package_id"]: (r["n_files"], r["n_bytes"], [f["file_id"] for f in r["files"]]) for r in m.collect()}
    assert got == {1: (1, 5, [9]), 2: (0, 0, [])}


def test_empty_catalog(spark):
    p, f, b = packages(spark, []), files(spark, []), spark.createDataFrame([], BLOBS)
    assert C.canonical_packages(p).count() == C.expand_clones(p, f).count() == C.recompute_refcounts(b, f).count() == C.manifests(p, f, b).count() == 0


def test_payload_types(spark):
    bodies = ["<a/>", "\n  <a>", "﻿<a>", "PK\x03\x04", "abc", "", None, "text", "<a>" + "x" * 1_000_000]
    df = spark.createDataFrame([(i, b, "1") for i, b in enumerate(bodies)], "i int, body string, supplier string")
    got = {r["i"]: (r["payload_type"], r["reason"]) for r in P.validate_uploads(df, "supplier", "body", 2_000_000).collect()}
    assert [got[i] for i in range(9)] == [("xml", None), ("xml", None), (None, "unsupported"), ("zip", None), (None, "too_small"), (None, "empty"), (None, "empty"), (None, "unsupported"), ("xml", None)]


def test_supplier_ids(spark):
    raws = ["1", "1000000", "0", "1000001", "abc", None, " "]
    df = spark.createDataFrame([(i, r, "<a/>") for i, r in enumerate(raws)], "i int, s string, body string")
    got = {r["i"]: (r["supplier_id"], r["reason"]) for r in P.validate_uploads(df, "s", "body").collect()}
    assert [got[i] for i in range(7)] == [(1, None), (1_000_000, None), (None, "out_of_range"), (None, "out_of_range"), (None, "not_numeric"), (None, "missing"), (None, "missing")]


def test_folder_names(spark):
    df = spark.createDataFrame([("2447",), ("1577-1601",), ("bad-name",), (None,)], "n string")
    assert [r[0] for r in df.select(P.folder_supplier(F.col("n"))).collect()] == [2447, 1577, None, None]


def test_global_ids(spark):
    df = spark.createDataFrame([(3, 123456789), (65535, 1), (0, 0)], "s int, l long").select("s", "l", S.global_id(F.col("s"), F.col("l")).alias("g"))
    rows = df.select("*", S.shard_of(F.col("g")).alias("s2"), S.local_of(F.col("g")).alias("l2")).collect()
    assert all(r["s"] == r["s2"] and r["l"] == r["l2"] for r in rows) and rows[1]["g"] < 0

import datetime as dt
import json

import pytest

from catalith.engine import Engine
from catalith.sources.folders import archive_samples, folder_bytes, folder_files, read_shards
from tests_support import BLOBS, FILES, H, PACKAGES, archive

NOW = dt.datetime(2025, 1, 1)


@pytest.fixture
def engine(spark, tmp_path):
    rows = {
        "packages": ([(1, 5, NOW, H[1], "xml", "single", None, None, 1, None), (2, 5, NOW, H[1].upper(), "xml", "single", None, 1, 1, None)], PACKAGES),
        "package_files": ([(10, 1, H[1], "original", "a.xml", None), (11, 2, H[1], "original", "b.xml", None), (12, 2, H[9], "member", None, 0)], FILES),
        "content_blobs": ([(H[1], 100, 50, 0, 0, 2, NOW)], BLOBS),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return Engine(spark, str(tmp_path))


def test_reads(spark, engine):
    ids = spark.createDataFrame([(2,), (2,), (99,)], "package_id long")
    (m,) = engine.manifests(ids).collect()
    assert (m["package_id"], m["n_files"], m["n_bytes"]) == (2, 1, 100) and engine.manifests().count() == 2
    assert [r["id"] for r in engine.files(ids).collect()] == [r["id"] for r in engine.originals(ids).collect()] == [11]
    one = spark.createDataFrame([(2, 12), (1, 10)], "package_id long, id long")
    assert [r["id"] for r in engine.files(one).collect()] == [10]
    assert [r["size"] for r in engine.lookup(spark.createDataFrame([(f"\\x{H[1]}",), (H[2],), (None,)], "hash string")).collect()] == [100]


def test_jobs(spark, engine):
    (s,) = engine.supplier_stats().collect()
    assert (s["total_packages"], s["total_refs"], s["duplicate_refs"]) == (2, 2, 1)
    assert engine.kpis(100).first()["efficiency"] == 2.0
    uploads = spark.createDataFrame([(7, "5", "<a/>"), (8, "5", "<a/>"), (9, "0", "<a/>")], "id long, supplier string, body string")
    assert sorted((r["id"], r["canonical_id"]) for r in engine.ingest(uploads).collect()) == [(7, 7), (8, 7)]


def test_folders(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "A.ZIP").write_bytes(archive(("x.XML", b"<x/>"), ("y.txt", b"y"), ("z.xml", b"<z/>")))
    (tmp_path / "bad.zip").write_bytes(b"PK nothing")
    (tmp_path / "shards.json").write_text(json.dumps([{"shard_id": 1, "state": "active"}, {"shard_id": 2, "total_bytes": 5}]))
    assert sorted(r["filename"] for r in archive_samples(spark, str(tmp_path)).collect()) == ["x.XML", "z.xml"]
    assert archive_samples(spark, str(tmp_path), most=1).count() == 1
    total = folder_bytes(spark, str(tmp_path)).first()
    assert total["n_files"] == 3 and total["n_bytes"] == sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file())
    assert {len(r["sha256"]) for r in folder_files(spark, str(tmp_path), True).collect()} == {64}
    assert read_shards(spark, str(tmp_path / "shards.json")).count() == 2 and read_shards(spark, str(tmp_path / "none.json")).count() == 0

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.operators.rebuild import rebuild
from catalith.plans.storage import ingest_pipeline, stream_dedup
from catalith.sources.journal import ENTRY
from catalith.streaming.ingest import ingest_batch, ingest_stream

SCHEMA = "id long, supplier string, body string"


def test_many_copies_have_one_canonical_package(spark):
    df = spark.createDataFrame([(i, "2447", "<a/>") for i in range(100)] + [(100, "x", "<a/>"), (101, "1", None), (102, "1", "plain")], SCHEMA)
    got = ingest_batch(df, None).collect()
    assert len(got) == 100 and {r["canonical_id"] for r in got} == {0} and sum(r["is_clone"] for r in got) == 99


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "1", f"<a>{i % 7}</a>" if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    for part in range(3):
        df.where(F.col("id").between(part * 20, part * 20 + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest_stream(source, str(tmp_path / "table"), str(tmp_path / "log")).awaitTermination()
    taken = spark.read.parquet(str(tmp_path / "table"))
    want = {(r["id"], r["canonical_id"], r["is_clone"]) for r in ingest_batch(df, None).collect()}
    assert {(r["id"], r["canonical_id"], r["is_clone"]) for r in taken.collect()} == want


def test_texts_of_any_size(spark, tmp_path):
    texts = ["", "", "4", "42", "42", "No.", " ", "\u3000", "é", "plain", "plain", "<a/>", "PK", None, None]
    df = spark.createDataFrame([(100 - i, 7, t) for i, t in enumerate(texts)], "doc_id long, author_id long, text string")
    # longer than an upload may be, equal but for the last character
    long_ = spark.range(200, 204).select(F.col("id").alias("doc_id"), F.lit(7).cast("long").alias("author_id"), F.concat(F.repeat(F.lit("a"), 16 << 20), (F.col("id") % 2).cast("string")).alias("text"))
    df.unionByName(long_).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = docs.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    want = {tuple(r) for r in first.select("doc_id", F.sha2(F.col("text").cast("binary"), 256)).collect()}
    got = [tuple(r) for r in stream_dedup(spark, str(tmp_path)).collect()]
    assert len(want) == 12 and len(got) == len(set(got)) and set(got) == want
    # uploads must have 4 bytes, as the query's SQL says, and may have any number of them
    assert {r["doc_id"] for r in ingest_pipeline(spark, str(tmp_path)).collect()} == {89, 90, 91, 200, 201, 202, 203}


def test_rebuild(spark):
    h = "ab" * 32
    files = [{"file_id": 2001, "blob_hash": h, "role": "original", "original_filename": None, "sequence_number": None}]
    entry = {"package_id": 1001, "supplier_id": 1577, "files": files}
    schema = T.StructType([T.StructField("line_no", T.LongType()), T.StructField("e", T.StructType.fromDDL(ENTRY))])
    journal = spark.createDataFrame([(1, {**entry, "supplier_id": 1}), (2, entry)], schema)
    journal = journal.select("line_no", "e.*")
    index = spark.createDataFrame([(1, 0, 0, 200, 180, bytes.fromhex(h)), (2, 0, 9, 0, 50, None)], "entry_no long, segment_id int, offset long, logical_size long, stored_size long, hash binary")
    out = rebuild(journal, index)
    (p,), (f,), (b,) = out["packages"].collect(), out["package_files"].collect(), out["content_blobs"].collect()
    assert (p["id"], p["supplier_id"], f["id"], b["content_hash"], b["ref_count"]) == (1001, 1577, 2001, h, 1)
    assert all(t.count() == 0 for t in rebuild(journal.limit(0), index.limit(0)).values())


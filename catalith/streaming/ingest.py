"""Uploads taken in by batch or by stream, with the same plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalith.operators.payloads import validate_uploads
from catalith.operators.skew import salted_left_join
from catalith.session import cut, drop_cut, remove, shared_dir
from catalith.sources.buckets import BucketStore


def ingest_batch(uploads: DataFrame, stored: DataFrame | None, any_text: bool = False, max_bytes: int | None = 16 << 20, any_size: bool = False) -> DataFrame:
    """id, supplier_id, payload_type, n_bytes, package_hash, canonical_id, is_clone of the accepted uploads of a batch.

    uploads: id BIGINT, supplier, body STRING. stored: package_hash, canonical_id of what was taken in before (None:
    nothing), one row a hash. The first upload with the same bytes, stored ones before those of the batch and lower ids
    before higher, stands for all. any_text also accepts bodies that are neither XML nor an archive, any_size also those
    that are empty, too small or too large, of whatever kind (a null body is none and never accepted). A body is hashed
    where it is read; only its hash is shuffled.
    """
    checked = validate_uploads(uploads, "supplier", "body", max_bytes)
    lifted = ["unsupported"] * any_text + ["empty", "too_small", "too_large"] * any_size
    fine = F.col("body").isNotNull() & (F.col("reason").isNull() | F.col("reason").isin(lifted))
    rows = checked.where(fine & F.col("id").isNotNull()).select("id", "supplier_id", "payload_type", "n_bytes", F.sha2(F.encode("body", "utf-8"), 256).alias("package_hash"))
    first = rows.groupBy("package_hash").agg(F.min("id").alias("first"))
    if stored is not None:
        first = first.join(stored.select("package_hash", F.col("canonical_id").alias("before")), "package_hash", "left").select("package_hash", F.coalesce("before", "first").alias("first"))
    canonical = F.col("first")
    return rows.join(first, "package_hash").select("id", "supplier_id", "payload_type", "n_bytes", "package_hash", canonical.alias("canonical_id"), (canonical != F.col("id")).alias("is_clone"))


def ingest_stream(uploads: DataFrame, table_path: str, checkpoint: str, any_text: bool = False, any_size: bool = False, buckets: int = 64) -> StreamingQuery:
    """A stream of uploads taken in batch by batch into the Parquet table at table_path, until the source is read to its end.

    Beside the table, at <table_path>_hashes, the hashes taken in stand in buckets; a batch opens the buckets its own
    hashes fall into and appends those that are new, each once. A batch is written under its number and replaces what
    an attempt before a failure left there, so each upload is taken in once.
    """
    known = BucketStore(uploads.sparkSession, f"{table_path}_hashes", "package_hash string, before long", "package_hash", buckets)

    def take(batch: DataFrame, number: int) -> None:
        rows = cut(ingest_batch(batch, None, any_text, any_size=any_size))
        first = rows.groupBy("package_hash").agg(F.min("canonical_id").alias("first"))
        stored = known.around(first, number).groupBy("package_hash").agg(F.min("before").alias("before"))
        first = cut(first.join(stored, "package_hash", "left"))
        led = salted_left_join(rows.drop("canonical_id", "is_clone"), first.select("package_hash", F.coalesce("before", "first").alias("canonical_id")), "package_hash", rows.count())
        led = led.select("id", "supplier_id", "payload_type", "n_bytes", "package_hash", "canonical_id", (F.col("canonical_id") != F.col("id")).alias("is_clone"))
        led.write.mode("overwrite").parquet(f"{table_path}/batch={number}")
        known.put(first.where(F.col("before").isNull()).select("package_hash", F.col("first").alias("before")), number)
        drop_cut(rows), drop_cut(first)

    return uploads.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, package_hash: the first document of each text, by a stream over the table into a table in the shared folder.

    Texts of any size count, the empty one too; documents whose doc_id or text is null take no part.
    """
    schema = "doc_id BIGINT, text STRING"
    path = f"{sf_dir}/documents.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    source = spark.readStream.schema(schema).parquet(path) if folder else spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    uploads = source.select(F.col("doc_id").alias("id"), F.lit("1").alias("supplier"), F.col("text").alias("body"))
    own = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    ingest_stream(uploads, f"{own}/table", f"{own}/log", any_text=True, any_size=True).awaitTermination()
    taken = cut(spark.read.parquet(f"{own}/table"))
    remove(spark, own)
    return taken.where(~F.col("is_clone")).select(F.col("id").alias("doc_id"), "package_hash")

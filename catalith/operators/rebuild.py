"""The catalog made anew from the journal and the segment index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions.hashes import hash_digits
from catalith.operators.catalog import reference_counts


def rebuild(journal: DataFrame, index: DataFrame) -> dict[str, DataFrame]:
    """packages, package_files and content_blobs as of the journal's and the index's last word.

    Of a package's lines the last counts, of a hash's entries the last; a stored size of 0 falls back to the logical
    one. References are those of the files restored. Lines without a package and entries without a hash are left out;
    empty inputs give empty tables.
    """
    head = ["supplier_id", "received_at", "package_hash", "payload_type", "storage_mode", "original_filename", "canonical_package_id", "file_count", "unpack_error"]
    rows = journal.where(F.col("package_id").isNotNull())
    last = rows.groupBy("package_id").agg(F.max("line_no").alias("line_no"))
    kept = rows.join(last, ["package_id", "line_no"])
    packages = kept.select(F.col("package_id").alias("id"), *head).withColumns({"received_at": F.col("received_at").try_cast("timestamp"), "package_hash": hash_digits(F.col("package_hash"))})
    f = kept.select("package_id", F.explode("files").alias("f")).where(F.col("f").isNotNull())
    files = f.select(F.col("f.file_id").alias("id"), "package_id", hash_digits(F.col("f.blob_hash")).alias("blob_hash"), "f.role", "f.original_filename", "f.sequence_number")
    entries = index.where(F.col("hash").isNotNull()).groupBy(F.lower(F.hex("hash")).alias("content_hash")).agg(
        F.max_by(F.struct(F.col("logical_size").alias("size"), "stored_size", "segment_id", "offset"), "entry_no").alias("e")
    )
    counts = reference_counts(files)
    stored = F.when(F.col("e.stored_size") == 0, F.col("e.size")).otherwise(F.col("e.stored_size"))
    blobs = entries.join(counts, entries["content_hash"] == counts["blob_hash"], "left").select(
        "content_hash", "e.size", stored.alias("stored_size"), "e.segment_id", F.coalesce("cnt", F.lit(0)).alias("ref_count")
    )
    return {"packages": packages, "package_files": files, "content_blobs": blobs}

"""Uploads taken into the catalog: packages, their files and their blobs, archives unpacked at once or later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.operators.payloads import LARGE_BYTES, LARGE_ENTRIES, archive_route, validate_uploads
from catalith.operators.skew import salted_left_join
from catalith.session import cut
from catalith.sources.segments import archive_members, entry_count

#: Fixed value: the name of the file that tells why an archive could not be unpacked.
ERROR_NAME = "_unpack_error.txt"
_HEAD = ["id", "supplier_id", "received_at", "package_hash", "payload_type", "storage_mode", "original_filename", "canonical_package_id", "file_count", "unpack_error"]
_FILE = ["package_id", "role", "original_filename", "sequence_number", "blob_hash", "size"]


def _opened(archives: DataFrame) -> DataFrame:
    """The member and error files of archives (id, body), in the columns of a file; contents are hashed where they are unpacked."""
    members = archive_members(archives, "id", "body")
    failed = F.col("error").isNotNull()
    data = F.when(failed, F.encode("error", "utf-8")).otherwise(F.col("data"))
    return members.select(
        F.col("id").alias("package_id"),
        F.when(failed, "unpack_error").otherwise("member").alias("role"),
        F.when(failed, ERROR_NAME).otherwise(F.col("filename")).alias("original_filename"),
        F.when(~failed, F.col("sequence_number")).alias("sequence_number"),
        F.sha2(data, 256).alias("blob_hash"),
        F.octet_length(data).alias("size"),
        "error",
    )


def _counted(opened: DataFrame) -> DataFrame:
    """package_id, n_members, failure: what unpacking gave, one row a package that gave anything."""
    return opened.groupBy("package_id").agg(F.count("*").alias("n_members"), F.max("error").alias("failure"))


def take_in(uploads: DataFrame, stored_packages: DataFrame | None = None, stored_files: DataFrame | None = None, max_bytes: int | None = 16 << 20, large_bytes: int = LARGE_BYTES, large_entries: int = LARGE_ENTRIES) -> dict[str, DataFrame]:
    """packages and package_files of a batch of uploads, and rejected (id, reason).

    uploads: id BIGINT (unique), supplier, received_at TIMESTAMP, filename STRING, body BINARY. stored_packages and
    stored_files: what was taken in before, in the columns of the results. The first upload with the same bytes, stored
    ones first, then by id, is canonical; the others are clones and take over its mode, its count and its files. An XML
    is one file. An archive over either limit is kept whole (raw_large) until unpack_late; any other is unpacked: its
    original and its members, or, if it cannot be read, its original and a file with the error. Folders and names with
    .. are left out. Uploads that validate_uploads refuses, or whose id is null, give no package.

    Bodies are hashed and unpacked where they are read and never shuffled; the clones of a body that a third of all
    uploads have are dealt out.
    """
    checked = validate_uploads(uploads, "supplier", "body", max_bytes)
    fine = F.col("reason").isNull() & F.col("id").isNotNull()
    good = checked.where(fine)
    heads = good.select("id", "supplier_id", "received_at", F.sha2("body", 256).alias("package_hash"), "payload_type", F.col("filename").alias("original_filename"), F.col("n_bytes").alias("size"))
    heads = cut(heads)
    n = heads.count()
    first = heads.groupBy("package_hash").agg(F.min("id").alias("first"))
    if stored_packages is not None:
        before = stored_packages.where(F.col("package_hash").isNotNull()).groupBy("package_hash").agg(F.min(F.coalesce("canonical_package_id", "id")).alias("before"))
        first = first.join(before, "package_hash", "left").select("package_hash", F.coalesce("before", "first").alias("first"))
    heads = cut(salted_left_join(heads, first, "package_hash", n))

    zips = entry_count(good.where(F.col("payload_type") == "zip").select("id", "n_bytes", "body"), "body")
    small = archive_route(F.col("n_bytes"), F.col("n_entries"), large_bytes, large_entries) == "zip_with_members"
    opened = cut(_opened(zips.where(small).select("id", "body")))
    routes = zips.select(F.col("id").alias("package_id"), small.alias("small"))
    told = routes.join(_counted(opened), "package_id", "left")
    canonical = heads.where(F.col("id") == F.col("first"))
    mode = F.when(F.col("payload_type") == "xml", "single").when(F.col("small"), "zip_with_members").otherwise("raw_large")
    count = 1 + F.coalesce("n_members", F.lit(0))
    own = canonical.join(told, canonical["id"] == told["package_id"], "left")
    own = cut(own.select(*_HEAD[:5], mode.alias("storage_mode"), "original_filename", F.lit(None).cast("long").alias("canonical_package_id"), count.cast("int").alias("file_count"), F.col("failure").alias("unpack_error")))
    originals = canonical.select(F.col("id").alias("package_id"), F.lit("original").alias("role"), "original_filename", F.lit(None).cast("int").alias("sequence_number"), F.col("package_hash").alias("blob_hash"), "size")
    inside = opened.select(*_FILE).join(own.select(F.col("id").alias("package_id")), "package_id", "left_semi")
    files = originals.unionByName(inside)

    known, known_files = own, files
    if stored_packages is not None:
        known, known_files = own.unionByName(stored_packages.select(*_HEAD)), files.unionByName(stored_files.select(*_FILE))
    clones = heads.where(F.col("id") != F.col("first")).withColumnRenamed("first", "canonical_package_id").drop("size")
    given = known.select(F.col("id").alias("canonical_package_id"), "storage_mode", "file_count", "unpack_error")
    copies = salted_left_join(clones, given, "canonical_package_id", n)
    packages = own.unionByName(copies.select(*_HEAD))
    return {"packages": packages, "package_files": files.unionByName(clone_files(clones, known_files)), "rejected": checked.where(~fine).select("id", "reason")}


def clone_files(clones: DataFrame, files: DataFrame) -> DataFrame:
    """The files clones (id, canonical_package_id) take over from their canonical packages."""
    theirs = clones.select("id", F.col("canonical_package_id").alias("package_id"))
    return files.join(theirs, "package_id").select(F.col("id").alias("package_id"), *_FILE[1:])


def unpack_late(packages: DataFrame, files: DataFrame, bodies: DataFrame) -> dict[str, DataFrame]:
    """packages and package_files once the archives kept whole are unpacked, and their early clones with them.

    bodies: id, body BINARY of canonical packages; only those of packages that are raw_large are opened, so doing it
    again changes nothing. A package whose body is not among them stays as it is.
    """
    pending = packages.where((F.col("storage_mode") == "raw_large") & F.col("canonical_package_id").isNull()).select("id")
    opened = cut(_opened(bodies.select("id", "body").join(pending, "id", "left_semi")))
    done = bodies.select("id").join(pending, "id", "left_semi").select(F.col("id").alias("package_id")).distinct().join(_counted(opened), "package_id", "left")
    done = done.select(F.col("package_id").alias("_done"), (1 + F.coalesce("n_members", F.lit(0))).cast("int").alias("_count"), F.col("failure").alias("_failure"))
    lead = F.coalesce("canonical_package_id", "id")
    keyed = packages.withColumn("_done", lead)
    joined = salted_left_join(keyed, done, "_done", packages.count())
    now = F.col("_count").isNotNull() & (F.col("storage_mode") == "raw_large")
    new = {"storage_mode": F.when(now, "zip_with_members").otherwise(F.col("storage_mode")), "file_count": F.when(now, F.col("_count")).otherwise(F.col("file_count")), "unpack_error": F.when(now, F.col("_failure")).otherwise(F.col("unpack_error"))}
    clones = packages.where((F.col("storage_mode") == "raw_large") & F.col("canonical_package_id").isNotNull())
    added = opened.select(*_FILE)
    return {"packages": joined.withColumns(new).select(*_HEAD), "package_files": files.unionByName(added).unionByName(clone_files(clones, added))}


def blob_rows(packages: DataFrame, files: DataFrame) -> DataFrame:
    """content_hash, size, ref_count, first_seen_at: the blobs that files name, how often, and when the first came."""
    when = packages.select(F.col("id").alias("package_id"), "received_at")
    dated = salted_left_join(files.where(F.col("blob_hash").isNotNull()), when, "package_id", files.count())
    return dated.groupBy(F.col("blob_hash").alias("content_hash")).agg(F.min("size").alias("size"), F.count("*").alias("ref_count"), F.min("received_at").alias("first_seen_at"))

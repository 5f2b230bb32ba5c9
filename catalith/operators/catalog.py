"""The catalog of packages, files and blobs: de-duplication, references, assembly and roll-ups.

All tables may hold exact copies of rows; every operator counts a row once. Hash texts are compared by their digits
(functions.hashes.hash_digits); rows whose hash is null or blank name no blob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalith.functions.hashes import has_digits, hash_digits, known_digits


def clean(df: DataFrame, *hashes: str) -> DataFrame:
    """df without repeated rows, its hash columns as digits."""
    return df.withColumns({h: hash_digits(F.col(h)) for h in hashes}).distinct()


def named(df: DataFrame, *columns: str) -> DataFrame:
    """The rows of df, without repeats and with only these columns, whose blob_hash names a blob, as digits that are never null."""
    rows = df.where(has_digits(F.col("blob_hash"))).select(*columns, known_digits(F.col("blob_hash")).alias("blob_hash"))
    return rows.distinct()


def blobs(df: DataFrame) -> DataFrame:
    """One row for each content_hash: of rows written differently the one seen first (then placed first)."""
    rest = [c for c in df.columns if c != "content_hash"]
    order = F.struct(F.col("first_seen_at").isNull(), "first_seen_at", "segment_id", "offset")
    keyed = df.where(has_digits(F.col("content_hash"))).select(known_digits(F.col("content_hash")).alias("content_hash"), F.struct(*rest).alias("row"), order.alias("order"))
    return keyed.groupBy("content_hash").agg(F.min_by("row", "order").alias("row")).select("content_hash", "row.*")


def _spread(digits: Column, number: Column) -> Column:
    """Digits as a join key; where they are null a text of its own for each row, which meets nothing, so that nulls are spread."""
    return F.coalesce(digits, F.concat(F.lit("-"), number.cast("string")))


def canonical_packages(packages: DataFrame) -> DataFrame:
    """id, package_hash, canonical_id, is_clone: the least id with the same hash stands for all; a package without a hash stands for itself.

    The least id of a hash is found by an aggregate that is folded before the shuffle, and joined back; a hash with
    a third of all rows is split by the skew join.
    """
    slim = packages.select("id", hash_digits(F.col("package_hash")).alias("package_hash")).where(F.col("id").isNotNull()).distinct()
    hashed = packages.where(F.col("id").isNotNull() & has_digits(F.col("package_hash")))
    first = hashed.groupBy(known_digits(F.col("package_hash")).alias("h")).agg(F.min("id").alias("first"))
    joined = slim.join(first, _spread(slim["package_hash"], slim["id"]) == first["h"], "left")
    canonical = F.coalesce("first", "id")
    return joined.select("id", "package_hash", canonical.alias("canonical_id"), (canonical != F.col("id")).alias("is_clone"))


def reference_counts(files: DataFrame) -> DataFrame:
    """blob_hash, cnt: how many file rows name each blob."""
    return named(files, "id").groupBy("blob_hash").agg(F.count("*").alias("cnt"))


def recompute_refcounts(content: DataFrame, files: DataFrame) -> DataFrame:
    """content_hash, ref_count, was: the references of every blob, 0 without any; was is the count stored before."""
    counts = reference_counts(files)
    stored = blobs(content).select("content_hash", F.col("ref_count").alias("was"))
    return stored.join(counts, stored["content_hash"] == counts["blob_hash"], "left").select("content_hash", F.coalesce("cnt", F.lit(0)).alias("ref_count"), "was")


def files_with_blobs(files: DataFrame, content: DataFrame) -> DataFrame:
    """The files whose blob is known, with its size and place (inner join)."""
    f = named(files, "id", "package_id", "role", "original_filename", "sequence_number")
    b = blobs(content).select("content_hash", "size", "stored_size", "segment_id", "offset")
    return f.join(b, f["blob_hash"] == b["content_hash"]).drop("content_hash")


def manifests(packages: DataFrame, files: DataFrame, content: DataFrame) -> DataFrame:
    """package_id, supplier_id, storage_mode, n_files, n_bytes, files (array of structs by file id): one row a package.

    A package without known files has an empty array. The files of an archive are gathered into one row, as in a
    manifest; the number of them is bounded by the archive.
    """
    known = files_with_blobs(files, content).select("package_id", F.struct(F.col("id").alias("file_id"), "role", "blob_hash", "original_filename", "sequence_number", "size").alias("f"))
    lists = known.groupBy("package_id").agg(F.sort_array(F.collect_list("f")).alias("files"))
    head = packages.select("id", "supplier_id", "storage_mode").where(F.col("id").isNotNull()).distinct()
    joined = head.join(lists, head["id"] == lists["package_id"], "left")
    listed = F.coalesce("files", F.array())
    total = F.aggregate("files", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["size"], F.lit(0)))
    return joined.select(F.col("id").alias("package_id"), "supplier_id", "storage_mode", F.size(listed).alias("n_files"), F.coalesce(total, F.lit(0)).alias("n_bytes"), listed.alias("files"))


def expand_clones(packages: DataFrame, files: DataFrame) -> DataFrame:
    """package_id, role, sequence_number, original_filename, blob_hash: the file rows each clone takes over from its canonical package."""
    clones = canonical_packages(packages).where("is_clone").select(F.col("id").alias("clone_id"), "canonical_id")
    f = clean(files.select("id", "package_id", "blob_hash", "role", "original_filename", "sequence_number"), "blob_hash")
    return clones.join(f, clones["canonical_id"] == f["package_id"]).select(F.col("clone_id").alias("package_id"), "role", "sequence_number", "original_filename", "blob_hash")


def missing_clone_files(packages: DataFrame, files: DataFrame) -> DataFrame:
    """The member and error rows that clones lack of those their canonical package has.

    Rows are matched by role, sequence number (-1 if null), name (empty if null) and hash; a row that repeats in the
    canonical package is missing once.
    """
    kinds = F.col("role").isin("member", "unpack_error")
    key = [F.col("role"), F.coalesce("sequence_number", F.lit(-1)).alias("sequence_number"), F.coalesce("original_filename", F.lit("")).alias("original_filename"), F.coalesce("blob_hash", F.lit("")).alias("blob_hash")]
    wanted = expand_clones(packages, files).where(kinds).select("package_id", *key).distinct()
    have = clean(files.select("package_id", "blob_hash", "role", "original_filename", "sequence_number"), "blob_hash").where(kinds).select("package_id", *key)
    return wanted.join(have, wanted.columns, "left_anti")


def ingest_counters(packages: DataFrame, files: DataFrame) -> DataFrame:
    """id, supplier_id, received_at, file_count, new_refs, duplicate_refs of every package, as if uploaded in the order of ids.

    A reference is new if its file id is the least that names the blob. Of a package that repeats an earlier one all
    files count as duplicates.
    """
    f = named(files, "id", "package_id")
    first = f.groupBy("blob_hash").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("is_first"))
    counted = f.join(first, "id", "left").groupBy("package_id").agg(F.count_if(F.col("is_first")).alias("new"), F.count_if(F.col("is_first").isNull()).alias("dup"))
    # one distinct of the packages serves both sides of the join
    rows = packages.where(F.col("id").isNotNull()).select("id", "supplier_id", "received_at", "file_count", hash_digits(F.col("package_hash")).alias("package_hash")).distinct()
    least = rows.where(F.col("package_hash").isNotNull()).groupBy(F.col("package_hash").alias("h")).agg(F.min("id").alias("least"))
    head = rows.join(least, _spread(F.col("package_hash"), F.col("id")) == F.col("h"), "left").withColumn("is_clone", F.coalesce(F.col("least") != F.col("id"), F.lit(False)))
    head = head.join(counted, F.col("id") == F.col("package_id"), "left")
    count = F.coalesce("file_count", F.lit(0))
    new = F.when(F.col("is_clone"), F.lit(0)).otherwise(F.coalesce("new", F.lit(0))).alias("new_refs")
    dup = F.when(F.col("is_clone"), count).otherwise(F.coalesce("dup", F.lit(0))).alias("duplicate_refs")
    return head.select("id", "supplier_id", "received_at", count.alias("file_count"), new, dup)


def supplier_stats(counters: DataFrame) -> DataFrame:
    """supplier_id, total_packages, total_refs, duplicate_refs, dedup_ratio (0 without references), last_activity; null is a supplier of its own."""
    per = counters.groupBy("supplier_id").agg(
        F.count("*").alias("total_packages"),
        F.sum("file_count").cast("long").alias("total_refs"),
        F.sum("duplicate_refs").cast("long").alias("duplicate_refs"),
        F.max("received_at").alias("last_activity"),
    )
    ratio = F.when(F.col("total_refs") == 0, 0.0).otherwise(F.col("duplicate_refs") / F.col("total_refs"))
    return per.withColumn("dedup_ratio", ratio)


def member_sequence(files: DataFrame) -> DataFrame:
    """id, package_id, position: the place, from 0, of each member among its package's members by id; no name with .. counts."""
    kept = F.col("role").eqNullSafe("member") & ~F.coalesce(F.col("original_filename"), F.lit("")).contains("..")
    f = files.where(kept & F.col("package_id").isNotNull()).select("id", "package_id").distinct()
    return f.withColumn("position", F.row_number().over(W.partitionBy("package_id").orderBy("id")) - 1)


def journal_latest(journal: DataFrame) -> DataFrame:
    """The last snapshot of each package by line_no: line_no, package_id, supplier_id, file_count, files."""
    rows = journal.where(F.col("package_id").isNotNull()).select("package_id", "line_no", F.struct("supplier_id", "file_count", "files").alias("row"))
    return rows.groupBy("package_id").agg(F.max("line_no").alias("line_no"), F.max_by("row", "line_no").alias("row")).select("line_no", "package_id", "row.*")


def flat_totals(content: DataFrame) -> DataFrame:
    """logical_bytes, stored_bytes (size where the stored one is unknown), referenced_bytes over all blobs; 0 without any."""
    b = blobs(content)
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return b.agg(zero(size, "logical_bytes"), zero(F.when(F.col("stored_size") > 0, F.col("stored_size").cast("long")).otherwise(size), "stored_bytes"), zero(size * F.col("ref_count"), "referenced_bytes"))


def kpis(totals: DataFrame, segment_bytes: Column) -> DataFrame:
    """totals with compression_ratio (1 if nothing is stored), savings_percent (not below 0) and efficiency (1 without segments)."""
    logical, stored = F.col("logical_bytes"), F.col("stored_bytes")
    return totals.withColumns(
        {
            "compression_ratio": F.when(stored > 0, logical / stored).otherwise(1.0),
            "savings_percent": F.when(logical > 0, F.greatest(F.lit(0.0), (1 - stored / logical) * 100)).otherwise(0.0),
            "efficiency": F.when(segment_bytes > 0, F.col("referenced_bytes") / segment_bytes).otherwise(1.0),
        }
    )

"""Folders of files: their sizes, samples from archives in them, and shard listings."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.session import exists
from catalith.sources.segments import archive_members, opened

SHARD = "shard_id INT, shard_uuid STRING, state STRING, primary_url STRING, replica_url STRING, total_bytes BIGINT"


def _listed(spark: SparkSession, path: str, digests: bool) -> DataFrame:
    """path (below the folder), size, modified_unix, and digest if asked for, of all files under path, empty ones too; none if it does not exist.

    The names come from one listing in the driver, a row a file; digests are made by tasks, a block at a time.
    """
    system, root = opened(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    rows = [(f.path[len(root) :].lstrip("/"), f.size, (f.mtime_ns or 0) // 10**9) for f in found if f.is_file]
    files = spark.createDataFrame(rows, "path string, size long, modified_unix long")

    def run(batches):
        system, root = opened(path)
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with system.open_input_stream(f"{root}/{name}") as data:
                    while block := data.read(1 << 22):
                        digest.update(block)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "digest"])

    return files.repartition("path").mapInArrow(run, "path string, size long, modified_unix long, digest string") if digests else files


def folder_files(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """name, size, modified_unix of all files under path, and sha256 if asked for; the contents are read only then."""
    columns = [F.element_at(F.split("path", "/"), -1).alias("name"), "size", "modified_unix"]
    return _listed(spark, path, digests).select(*columns, *([F.col("digest").alias("sha256")] if digests else []))


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    """n_files and n_bytes of everything under path, whatever its kind; 0 for an empty folder."""
    return folder_files(spark, path).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))


def archive_samples(spark: SparkSession, path: str, suffix: str = ".xml", most: int = 500) -> DataFrame:
    """path, sequence_number, filename, data: up to `most` members with the suffix (in any case) of the archives under path.

    Archives that cannot be read are skipped. The limit is the sampler's: it bounds what a dictionary is trained on.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path)
    members = archive_members(found, "path", "content").where(F.col("error").isNull() & F.lower("filename").endswith(suffix))
    return members.drop("error").orderBy("path", "sequence_number").limit(most)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a JSON array in a file; none if the file does not exist."""
    if not exists(spark, path):
        return spark.createDataFrame([], SHARD)
    return spark.read.schema(SHARD).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def sync_folder(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copies the files under source that target lacks or holds otherwise; returns name and size of those copied.

    Both are folders or URIs all executors share. Files are compared by their digests and copied by the tasks, each
    under another name until it is complete. Files only target has stay. The copying happens when the result is read.
    """
    files = lambda path: _listed(spark, path, True).withColumnRenamed("path", "name")
    theirs = files(target).select("name", F.col("digest").alias("there"))
    due = files(source).join(theirs, "name", "left").where(F.col("there").isNull() | (F.col("there") != F.col("digest"))).select("name", "size")

    def run(batches):
        (src, root), (dst, to) = opened(source), opened(target)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                folder = f"{to}/{name}".rpartition("/")[0]
                dst.create_dir(folder, recursive=True)
                with src.open_input_stream(f"{root}/{name}") as data, dst.open_output_stream(f"{to}/{name}.part") as out:
                    while block := data.read(1 << 22):
                        out.write(block)
                dst.move(f"{to}/{name}.part", f"{to}/{name}")
            yield batch

    return due.repartition("name").mapInArrow(run, "name string, size long")

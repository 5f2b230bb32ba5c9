"""Segment files, their indexes and archives as tables."""

from __future__ import annotations

import io
import os
import warnings
import zipfile

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.operators.ordered import RECORD_OVERHEAD, pack_segments
from catalith.sources.records import INDEX_ROW, decode_index, decode_records, encode_footer, encode_index, encode_records, scan_segment

_NUMBER = r"segment_(\d+)\.[a-z]+$"


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", _NUMBER, 1).cast("int").alias("segment_id"), "path", "content")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """segment_id, offset, magic, size, payload, crc_ok: the records of all segment_*.dat files under path.

    Files are independent tasks' work; a file is held by its task, and its size is bounded by the rotation.
    """

    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(scan_segment(data.as_py()))
                at, magic, payload, good = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(rows), pa.int32()), pa.array(at, pa.int64()), pa.array(magic, pa.int64()), pa.array(map(len, payload), pa.int64()), pa.array(payload, pa.binary()), pa.array(good, pa.bool_())],
                    names=["segment_id", "offset", "magic", "size", "payload", "crc_ok"],
                )

    files = _binary(spark, path, "segment_*.dat").select("segment_id", "content")
    return files.mapInArrow(run, "segment_id int, offset long, magic long, size long, payload binary, crc_ok boolean")


def read_point(records: DataFrame, places: DataFrame, strict: bool = True) -> DataFrame:
    """The records at places (segment_id, offset); strict makes one with a wrong checksum an error."""
    found = records.join(places.select("segment_id", "offset").distinct(), ["segment_id", "offset"])
    return found.withColumn("crc_ok", F.when(F.col("crc_ok"), True).otherwise(F.raise_error(F.lit("wrong checksum")).cast("boolean"))) if strict else found


def read_indexes(spark: SparkSession, path: str) -> DataFrame:
    """segment_id and the columns of the index rows of all segment_*.idx files under path; a damaged file is an error."""
    numbers = [n for n in INDEX_ROW.names if n != "hash"]

    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = decode_index(data)
                columns = [pa.array(rows[n].astype(np.int64)) for n in numbers]
                hashes = pa.array([x.tobytes() for x in rows["hash"]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int32()), *columns, hashes], names=["segment_id", *numbers, "hash"])

    files = _binary(spark, path, "segment_*.idx").select("segment_id", "content")
    return files.mapInArrow(run, "segment_id int, " + ", ".join(f"{n} long" for n in numbers) + ", hash binary")


def opened(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, an object store) and the path in it."""
    return files.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def put(system: files.FileSystem, name: str, data: bytes) -> None:
    """Writes a file as a whole: it is there under its name only once it is complete."""
    with system.open_output_stream(f"{name}.part") as out:
        out.write(data)
    system.move(f"{name}.part", name)


def write_segments(records: DataFrame, path: str) -> DataFrame:
    """Writes segment files from segment_id, offset, magic, payload; returns segment_id, n_records, n_bytes of each.

    path is a folder or URI all executors share. The records of a segment, bounded by the rotation, are one task's work.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["offset"].to_pylist(), table["magic"].to_pylist(), table["payload"].to_pylist()))
        number = table["segment_id"][0].as_py()
        body = b"".join(encode_records([m for _, m, _ in rows], [p or b"" for *_, p in rows]))
        system, folder = opened(path)
        system.create_dir(folder, recursive=True)
        put(system, f"{folder}/segment_{number:04d}.dat", body + encode_footer(len(rows), len(body)))
        return pa.table({"segment_id": pa.array([number], pa.int32()), "n_records": [len(rows)], "n_bytes": [len(body)]})

    return records.select("segment_id", "offset", "magic", "payload").groupBy("segment_id").applyInArrow(run, "segment_id int, n_records long, n_bytes long")


_STORED = "shard_id int, segment_id int, offset long, stored_size long, logical_size long, magic long, hash binary, supplier_id long, dict_id long"


def store_contents(contents: DataFrame, path: str, most: int = 64 << 20) -> DataFrame:
    """Appends contents to the segments of their shards, with an index file beside each; returns the index rows.

    contents: shard_id INT, order BIGINT (unique in a shard), magic BIGINT, payload BINARY, hash BINARY (32 bytes),
    supplier_id, dict_id. A shard's contents are packed in their order into segments of at most most bytes
    (pack_segments), each written by one task under path/shard_<id>, a folder or URI all executors share. A null payload
    counts as an empty one. A segment is written as a whole, so doing it again after a failure changes nothing. Nothing
    is written before the result is read.
    """
    sized = contents.withColumn("size", F.coalesce(F.octet_length("payload"), F.lit(0)) + RECORD_OVERHEAD)
    packed = pack_segments(sized, "shard_id", "order", "size", most).withColumnRenamed("segment", "segment_id")
    names = [x.split()[0] for x in _STORED.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        payloads = [p or b"" for p in table["payload"].to_pylist()]
        records = encode_records(table["magic"].to_pylist(), payloads)
        table = table.append_column("stored_size", pa.array(map(len, records), pa.int64())).append_column("logical_size", pa.array(map(len, payloads), pa.int64()))
        rows = np.zeros(len(records), INDEX_ROW)
        for name in INDEX_ROW.names:
            values = table[name].to_pylist()
            rows[name] = [np.void((x or b"").ljust(32, b"\0")) for x in values] if name == "hash" else [x or 0 for x in values]
        body = b"".join(records)
        shard, segment = table["shard_id"][0].as_py(), table["segment_id"][0].as_py()
        system, folder = opened(f"{path}/shard_{shard:04d}")
        system.create_dir(folder, recursive=True)
        put(system, f"{folder}/segment_{segment:04d}.dat", body + encode_footer(len(records), len(body)))
        put(system, f"{folder}/segment_{segment:04d}.idx", encode_index(rows))
        return table.select(names)

    rows = contents.select("shard_id", "order", F.col("magic").cast("long").alias("magic"), "payload", "hash", F.col("supplier_id").cast("long").alias("supplier_id"), F.col("dict_id").cast("long").alias("dict_id"))
    return rows.join(packed, ["shard_id", "order"]).groupBy("shard_id", "segment_id").applyInArrow(run, _STORED)


def read_places(places: DataFrame, path: str, chunk: int = 32 << 20) -> DataFrame:
    """shard_id, segment_id, offset, magic, payload, crc_ok: the records at places (shard_id, segment_id, offset, stored_size, as in an index).

    Of the segment files under path only the asked byte ranges are read, about chunk bytes at a time; each place is
    read once, however often it is asked for.
    """

    def run(batches):
        system, folder = opened(path)
        open_, held, asked = (None, None), 0, []

        def flush() -> pa.RecordBatch:
            magic, payload, good = zip(*decode_records([raw for *_, raw in asked]))
            shard, segment, offset, _ = zip(*asked)
            return pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(segment, pa.int32()), pa.array(offset, pa.int64()), pa.array(magic, pa.int64()), pa.array(payload, pa.binary()), pa.array(good)],
                names=["shard_id", "segment_id", "offset", "magic", "payload", "crc_ok"],
            )

        for batch in batches:
            for shard, segment, offset, size in zip(*(c.to_pylist() for c in batch.columns)):
                if open_[0] != (shard, segment):
                    open_ = (shard, segment), system.open_input_file(f"{folder}/shard_{shard:04d}/segment_{segment:04d}.dat")
                asked.append((shard, segment, offset, open_[1].read_at(size, offset)))
                held += size
                if held >= chunk:
                    yield flush()
                    held, asked = 0, []
        if asked:
            yield flush()

    once = places.select("shard_id", "segment_id", "offset", "stored_size").distinct()
    dealt = once.repartition("shard_id", "segment_id").sortWithinPartitions("shard_id", "segment_id", "offset")
    return dealt.mapInArrow(run, "shard_id int, segment_id int, offset long, magic long, payload binary, crc_ok boolean")


def archive_members(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, sequence_number, filename, data, error: the members of the archives in a BINARY column.

    Folders and names with .. are left out, the others numbered from 0 in the archive's order. An archive that cannot
    be read as a whole, a null one among them, gives one row with the error and no member.
    """
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        kept = [x for x in z.infolist() if not x.is_dir() and ".." not in x.filename]
                        rows = [(n, x.filename, z.read(x), None) for n, x in enumerate(kept)]
                except Exception as e:  # whatever a damaged archive raises is its error
                    rows = [(None, None, None, str(e) or type(e).__name__)]
                if rows:
                    number, name, content, error = zip(*rows)
                    keys = batch.column(0).take(pa.array([i] * len(rows), pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(number, pa.int32()), pa.array(name, pa.string()), pa.array(content, pa.binary()), pa.array(error, pa.string())], names=[key, "sequence_number", "filename", "data", "error"])

    return df.select(key, body).mapInArrow(run, f"`{key}` {kind}, sequence_number int, filename string, data binary, error string")


def build_archives(df: DataFrame, key: str, members: str, to: str = "body") -> DataFrame:
    """key and to BINARY: an archive of the members, an ARRAY<STRUCT<name STRING, data BINARY>>, in their order; null for a null array."""
    kind = dict(df.dtypes)[key]

    def pack(rows) -> bytes | None:
        if rows is None:
            return None
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for x in rows:
                z.writestr(zipfile.ZipInfo(x["name"] or ""), x["data"] or b"")
        return out.getvalue()

    def run(batches):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # names may repeat
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(x) for x in batch.column(1).to_pylist()], pa.binary())], names=[key, to])

    return df.select(key, members).mapInArrow(run, f"`{key}` {kind}, `{to}` binary")


def entry_count(df: DataFrame, body: str, to: str = "n_entries") -> DataFrame:
    """df with to INT: the entries of the archive that are no folders, names with .. among them; null if it cannot be read."""

    def count(data):
        try:
            with zipfile.ZipFile(pa.BufferReader(data)) as z:
                return sum(not x.is_dir() for x in z.infolist())
        except Exception:  # whatever a damaged archive raises
            return None

    rest = df.drop(to)
    at = rest.columns.index(body)

    def run(batches):
        for batch in batches:
            counts = [count(x.as_buffer()) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int32())], names=[*batch.schema.names, to])

    return rest.mapInArrow(run, T.StructType([*rest.schema, T.StructField(to, T.IntegerType())]))

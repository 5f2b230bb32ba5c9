"""Compression of payloads with a dictionary trained on samples of them."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.sources.segments import opened, put

#: Payloads below this size are kept as they are.
LEAST = 64
FRAME = b"\x28\xb5\x2f\xfd"


def train_dictionary(samples: DataFrame, payload: str, order: str, size: int = 16 << 10, most: int = 500) -> bytes | None:
    """A dictionary trained on the first payloads by order, at most `most` of them; None where they are too few or too small."""
    rows = [bytes(r[0]) for r in samples.where(F.octet_length(payload) > 0).orderBy(order).select(payload).limit(most).collect()]
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def _with(dictionary: bytes | None):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def compress(df: DataFrame, payload: str, dictionary: bytes | None = None, to: str = "stored") -> DataFrame:
    """df with to BINARY and is_compressed: the payload as a frame where that is strictly smaller, else as it is; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(dictionary)  # at most the dictionary's size
    schema = df.drop(to, "is_compressed").schema.add(to, "binary").add("is_compressed", "boolean")

    def run(batches):
        coder = zstandard.ZstdCompressor(dict_data=_with(shared.value))
        for batch in batches:
            rows = batch.column(len(batch.columns) - 1).to_pylist()
            packed = [coder.compress(x) if x is not None and len(x) >= LEAST else None for x in rows]
            small = [p is not None and len(p) < len(x) for p, x in zip(packed, rows)]
            out = [p if s else x for p, s, x in zip(packed, small, rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary()), pa.array(small)], schema=pa.schema([*list(batch.schema)[:-1], (to, pa.binary()), ("is_compressed", pa.bool_())]))

    return df.drop(to, "is_compressed").withColumn("_payload", F.col(payload)).mapInArrow(run, schema)


def decompress(df: DataFrame, stored: str, dictionary: bytes | None = None, to: str = "payload") -> DataFrame:
    """df with to BINARY: what a frame holds; bytes that are no frame, and null, as they are."""
    shared = df.sparkSession.sparkContext.broadcast(dictionary)
    schema = df.drop(to).withColumn(to, F.col(stored)).schema

    def run(batches):
        coder = zstandard.ZstdDecompressor(dict_data=_with(shared.value))
        for batch in batches:
            out = [coder.decompress(x) if x is not None and x[:4] == FRAME else x for x in batch.column(len(batch.columns) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], schema=pa.schema([*list(batch.schema)[:-1], (to, pa.binary())]))

    return df.drop(to).withColumn("_stored", F.col(stored)).mapInArrow(run, schema) if to != stored else decompress(df.withColumnRenamed(stored, "_in"), "_in", dictionary, to).drop("_in")


def save_dictionary(folder: str, number: int, dictionary: bytes) -> str:
    """Writes a dictionary beside the segments, under its number and digest, and makes it the current one; returns its name.

    folder is a path or URI. The file that names the current dictionary is written last.
    """
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    digest = hashlib.sha256(dictionary).hexdigest()
    name = f"dict_{number:04d}_{digest[:16]}.zdict"
    put(system, f"{root}/{name}", dictionary)
    put(system, f"{root}/current.json", json.dumps({"id": number, "file": name, "sha256": digest}).encode())
    return name


def load_dictionary(folder: str) -> tuple[int, bytes] | None:
    """Number and bytes of the current dictionary, None without one; bytes that do not match their digest are an error."""
    system, root = opened(folder)

    def read(name: str) -> bytes:
        with system.open_input_stream(f"{root}/{name}") as file:
            return file.read()

    try:
        current = json.loads(read("current.json"))
    except FileNotFoundError:
        return None
    data = read(current["file"])
    if hashlib.sha256(data).hexdigest() != current["sha256"]:
        raise ValueError(f"{current['file']} does not match its digest")
    return current["id"], data

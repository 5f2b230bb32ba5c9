"""Queries of the data-quality operators: p1 to p4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.hashes import digits_sql, has_digits, hash_digits, hash_key, known_key
from catalith.functions.times import utc_month
from catalith.operators.diff import diff_cells
from catalith.operators.nested import JOURNAL, files_of_entries, schema_graph, shred, table_of
from catalith.operators.redelivery import accept_batch, first_deliveries, surplus_deliveries
from catalith.operators.references import bad_references, digest_ref, number_ref
from catalith.operators.skew import salted_left_join
from catalith.tables import table


def p1_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell in which the two listings differ, with both values."""
    columns = ("shard_id", "name", "size", "sha256")
    left, right = (table(spark, sf, f"segment_files_{side}", *columns) for side in ("primary", "replica"))
    fields = {"size": F.col("size"), "sha256": hash_digits(F.col("sha256"))}
    return diff_cells(left, right, ["shard_id", "name"], fields, ("primary", "replica"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_cells(spark, sf).select("shard_id", "name", "diff")


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of each kind by shard."""
    return p1_cells(spark, sf).groupBy("shard_id", "diff").agg(F.count("*").alias("n"))


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_journal", "line_no", "line")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return files_of_entries(shred(_raw(spark, sf), "line_no", "line", JOURNAL, with_fields=False))


def p2_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of entries."""
    fields = ["v", "supplier_id", "received_at", "package_hash", "payload_type", "storage_mode", "canonical_package_id", "original_filename", "file_count", "unpack_error"]
    return table_of(shred(_raw(spark, sf), "line_no", "line", JOURNAL), "entry", fields).withColumnRenamed("id", "package_id").drop("owner_id")


def p2_files(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of files, with the entry each belongs to."""
    fields = ["blob_hash", "role", "original_filename", "sequence_number"]
    return table_of(shred(_raw(spark, sf), "line_no", "line", JOURNAL), "file", fields).withColumnsRenamed({"id": "file_id", "owner_id": "package_id"})


def p2_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The tables the records fall into, and their rows."""
    return shred(_raw(spark, sf), "line_no", "line", JOURNAL, schema_graph(_raw(spark, sf), "line_no", "line", JOURNAL), False).groupBy("element").agg(F.count("*").alias("n_rows"))


def _bad(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda name, *columns: table(spark, sf, name, *columns)
    packages = t("packages", "id", "received_at").groupBy("id").agg(F.min("received_at").alias("at"))
    lit = lambda name: F.lit(name).alias("ref")
    named = t("package_files", "id", "package_id", "blob_hash")
    files = named.where(has_digits(F.col("blob_hash"))).select(F.col("id").alias("record_id"), "package_id", digest_ref(known_key(F.col("blob_hash"))).alias("key"))
    of_files = salted_left_join(files, packages.withColumnRenamed("id", "package_id"), "package_id", named.count()).select(lit("package_files.blob_hash"), "record_id", "key", "at")
    lines = t("journal", "received_at", "files").select(F.col("received_at").try_cast("timestamp").alias("at"), F.explode("files").alias("f"))
    of_lines = lines.where(has_digits(F.col("f.blob_hash"))).select(lit("journal.files.blob_hash"), F.col("f.file_id").alias("record_id"), digest_ref(known_key(F.col("f.blob_hash"))).alias("key"), "at")
    of_packages = t("packages", "id", "received_at", "canonical_package_id").select(lit("packages.canonical_package_id"), F.col("id").alias("record_id"), number_ref(F.col("canonical_package_id")).alias("key"), F.col("received_at").alias("at"))
    refs = of_files.unionByName(of_lines).unionByName(of_packages)
    keys = files.select("key").unionByName(of_lines.select("key")).unionByName(of_packages.select("key"))
    parents = t("content_blobs", "content_hash", "first_seen_at").where(has_digits(F.col("content_hash"))).select(digest_ref(known_key(F.col("content_hash"))).alias("key"), F.col("first_seen_at").alias("seen")).unionByName(
        t("packages", "id", "received_at").select(number_ref(F.col("id")).alias("key"), F.col("received_at").alias("seen"))
    )
    gone = t("removals").select(
        F.when(F.col("table_name") == "content_blobs", digest_ref(hash_key(F.col("row_key"))))
        .when(F.col("table_name") == "packages", number_ref(F.trim("row_key").try_cast("long")))
        .alias("key"),
        F.col("removed_at").alias("gone"),
    )
    return bad_references(refs, parents, gone, keys)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _bad(spark, sf).select("ref", "record_id", "state").distinct()


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bad references by referring column, month of receipt (UTC; null where the time is) and state."""
    month = utc_month(F.col("at")).alias("month")
    return _bad(spark, sf).select("ref", "record_id", "state", month).distinct().groupBy("ref", "month", "state").agg(F.count("*").alias("n"))


def _journal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "journal", "line_no", "batch_id", "package_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return surplus_deliveries(_journal(spark, sf).select("line_no", "package_id"), "package_id", "line_no").select("line_no")


def p4_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The one entry of each package that remains."""
    return first_deliveries(_journal(spark, sf), "package_id", "line_no")


def p4_by_arrival(spark: SparkSession, sf: str) -> DataFrame:
    """The entry of each package that was received first (by line where times are equal or missing)."""
    j = table(spark, sf, "journal", "line_no", "package_id", "received_at").withColumn("at", F.col("received_at").try_cast("timestamp"))
    return first_deliveries(j, "package_id", "line_no", ["at"]).select("line_no", "package_id", F.unix_micros("at").alias("arrived"))


def p4_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """What the second half of the batches adds to the first half's identifiers."""
    entries = _journal(spark, sf)
    last = entries.agg(F.max("batch_id").alias("last"))
    dated = entries.join(F.broadcast(last))  # one row
    new = F.col("batch_id") * 2 > F.col("last")
    return accept_batch(dated.where(~new), dated.where(new).drop("last"), "package_id", "line_no").select("line_no", "batch_id", "package_id")


_DISTINCT_LISTING = "SELECT shard_id, name, min(size) AS size, min({digits}) AS sha FROM {table} GROUP BY shard_id, name"
_LISTINGS = "WITH a AS ({}), b AS ({}), j AS (SELECT coalesce(a.shard_id, b.shard_id) AS shard_id, coalesce(a.name, b.name) AS name, a.size AS s1, b.size AS s2, a.sha AS h1, b.sha AS h2, a.name IS NULL AS no_a, b.name IS NULL AS no_b FROM a FULL JOIN b ON a.shard_id = b.shard_id AND a.name = b.name)".format(
    *(_DISTINCT_LISTING.format(digits=digits_sql("sha256"), table=f"segment_files_{side}") for side in ("primary", "replica"))
)
_CELLS = """{with_}
SELECT shard_id, name, 'only_primary' AS diff, NULL::VARCHAR AS primary_value, NULL::VARCHAR AS replica_value FROM j WHERE no_b
UNION ALL SELECT shard_id, name, 'only_replica', NULL, NULL FROM j WHERE no_a
UNION ALL SELECT shard_id, name, 'size', s1::VARCHAR, s2::VARCHAR FROM j WHERE NOT no_a AND NOT no_b AND s1 IS DISTINCT FROM s2
UNION ALL SELECT shard_id, name, 'sha256', h1, h2 FROM j WHERE NOT no_a AND NOT no_b AND h1 IS DISTINCT FROM h2""".format(with_=_LISTINGS)

# every node of every line; entries and what their own property files holds, lists of lists taken apart
_NUM = "CASE WHEN regexp_full_match(trim({0}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AND try_cast(trim({0}) AS DOUBLE) = floor(try_cast(trim({0}) AS DOUBLE)) THEN coalesce(try_cast(trim({0}) AS BIGINT), try_cast(try_cast(trim({0}) AS DOUBLE) AS BIGINT)) END"
_NESTED = f"""WITH RECURSIVE lines AS (SELECT line_no, trim(line, chr(32) || chr(9) || chr(10) || chr(13)) AS line FROM raw_journal),
t AS (SELECT l.line_no, t.key, t.type, t.atom, t.value, t.id, t.parent FROM (SELECT line_no, CASE WHEN json_valid(line) THEN line ELSE 'null' END AS line FROM lines WHERE line <> '') l, json_tree(l.line) t),
e AS (SELECT o.line_no, o.id, p.atom AS pid, p.type AS kind FROM t o JOIN t p ON p.line_no = o.line_no AND p.parent = o.id AND p.key = 'package_id' WHERE o.type = 'OBJECT' AND p.type <> 'NULL'),
h AS (SELECT e.line_no, e.id AS entry, f.id, f.type FROM e JOIN t f ON f.line_no = e.line_no AND f.parent = e.id AND f.key = 'files' WHERE f.type IN ('OBJECT', 'ARRAY')
  UNION ALL SELECT h.line_no, h.entry, x.id, x.type FROM h JOIN t x ON x.line_no = h.line_no AND x.parent = h.id WHERE h.type = 'ARRAY'),
f AS (SELECT line_no, entry, id FROM h WHERE type NOT IN ('ARRAY', 'NULL')),
i AS (SELECT f.line_no, f.entry, f.id, a.atom ->> '$' AS fid, a.type AS fkind FROM f LEFT JOIN t a ON a.line_no = f.line_no AND a.parent = f.id AND a.key = 'file_id'),
n AS (SELECT e.line_no, CASE WHEN e.kind <> 'BOOLEAN' THEN {_NUM.format("(e.pid ->> '$')")} END AS package_id, CASE WHEN i.id IS NULL THEN 0 WHEN i.fkind <> 'BOOLEAN' THEN {_NUM.format('i.fid')} END AS file_id FROM e LEFT JOIN i ON i.line_no = e.line_no AND i.entry = e.id)
SELECT DISTINCT line_no, package_id, file_id FROM n"""

_BLOBS = f"SELECT {digits_sql('content_hash')} AS h, min(first_seen_at) AS seen FROM content_blobs GROUP BY 1"
_BAD_SQL = f"""WITH blobs AS ({_BLOBS}),
pk AS (SELECT id, min(received_at) AS came FROM packages GROUP BY id),
gone AS (SELECT table_name, CASE WHEN table_name = 'content_blobs' THEN {digits_sql('row_key')} ELSE trim(row_key) END AS h, max(removed_at) AS gone FROM removals GROUP BY 1, 2),
refs AS (
  SELECT 'package_files.blob_hash' AS ref, f.id AS record_id, {digits_sql('f.blob_hash')} AS h, 'content_blobs' AS target, pk.came FROM package_files f LEFT JOIN pk ON f.package_id = pk.id
  UNION ALL SELECT 'journal.files.blob_hash', x.f.file_id, {digits_sql('x.f.blob_hash')}, 'content_blobs', x.came FROM (SELECT unnest(files) AS f, received_at::TIMESTAMPTZ AS came FROM journal) x WHERE x.f IS NOT NULL
  UNION ALL SELECT 'packages.canonical_package_id', id, canonical_package_id::VARCHAR, 'packages', received_at FROM packages),
parents AS (SELECT 'content_blobs' AS target, h, seen FROM blobs WHERE h IS NOT NULL UNION ALL SELECT 'packages', id::VARCHAR, came FROM pk WHERE id IS NOT NULL),
bad AS (SELECT r.ref, r.record_id, r.came,
  CASE WHEN p.h IS NULL AND g.h IS NULL THEN 'missing'
       WHEN g.h IS NOT NULL AND (p.h IS NULL OR NOT coalesce(p.seen > g.gone, false)) THEN 'deleted'
       WHEN p.seen > r.came THEN 'late' END AS state
  FROM refs r LEFT JOIN parents p ON p.target = r.target AND p.h = r.h LEFT JOIN gone g ON g.table_name = r.target AND g.h = r.h
  WHERE r.h IS NOT NULL)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_cells, p1_counts, p2_found, p2_entries, p2_files, p2_tables, p3_found, p3_counts, p4_found, p4_kept, p4_by_arrival, p4_accepted)}

SQL = {
    "p1_cells": _CELLS,
    "p1_found": f"SELECT shard_id, name, diff FROM ({_CELLS})",
    "p1_counts": f"SELECT shard_id, diff, count(*) AS n FROM ({_CELLS}) GROUP BY 1, 2",
    "p2_found": _NESTED,
    "p3_found": f"{_BAD_SQL} SELECT DISTINCT ref, record_id, state FROM bad WHERE state IS NOT NULL",
    "p3_counts": f"{_BAD_SQL} SELECT ref, month, state, count(*) AS n FROM (SELECT DISTINCT ref, record_id, state, strftime(came AT TIME ZONE 'UTC', '%Y-%m') AS month FROM bad WHERE state IS NOT NULL) GROUP BY 1, 2, 3",
    "p4_found": "SELECT line_no FROM (SELECT line_no, min(line_no) OVER (PARTITION BY package_id) AS first FROM journal WHERE package_id IS NOT NULL) WHERE line_no > first",
    "p4_kept": "SELECT line_no, batch_id, package_id FROM (SELECT *, min(line_no) OVER (PARTITION BY package_id) AS first FROM journal) WHERE line_no = first OR package_id IS NULL",
    "p4_by_arrival": """SELECT line_no, package_id, epoch_us(t) AS arrived FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY t NULLS LAST, line_no) AS n
FROM (SELECT line_no, package_id, try_cast(received_at AS TIMESTAMPTZ) AS t FROM journal)) WHERE n = 1 OR package_id IS NULL""",
    "p4_accepted": """WITH n AS (SELECT line_no, batch_id, package_id, batch_id * 2 > (SELECT max(batch_id) FROM journal) AS new FROM journal)
SELECT min(line_no) AS line_no, arg_min(batch_id, line_no) AS batch_id, package_id FROM n WHERE new AND package_id NOT IN (SELECT package_id FROM n WHERE NOT new) GROUP BY package_id""",
}

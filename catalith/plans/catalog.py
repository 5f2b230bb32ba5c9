"""Queries over packages, files, blobs and payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.hashes import digits_sql
from catalith.functions.times import utc_month
from catalith.operators import catalog as C
from catalith.operators import payloads as P
from catalith.operators.bloom import bloom_index, might_contain
from catalith.session import cut, shared_dir
from catalith.sources.buckets import BucketStore
from catalith.tables import table

QUERIES = {}
SQL = {}


def _query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


def _packages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "packages")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "package_files")


def _content(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "content_blobs")


def _joined(structs: str, field: str) -> Column:
    """One field of an array of structs as a text with commas."""
    return F.concat_ws(",", F.transform(structs, lambda x: x[field].cast("string")))


_P = "p AS (SELECT DISTINCT * FROM packages)"
_F = f"f AS (SELECT DISTINCT id, package_id, {digits_sql('blob_hash')} AS h, role, original_filename, sequence_number FROM package_files)"
_B = f"""b AS (SELECT * FROM (SELECT {digits_sql('content_hash')} AS h, size, stored_size, segment_id, "offset", ref_count, first_seen_at,
  row_number() OVER (PARTITION BY {digits_sql('content_hash')} ORDER BY first_seen_at NULLS LAST, segment_id NULLS FIRST, "offset" NULLS FIRST) AS rn FROM content_blobs) WHERE rn = 1 AND h IS NOT NULL)"""
_K = f"""k AS (SELECT id, h AS package_hash, CASE WHEN h IS NULL THEN id ELSE min(id) OVER (PARTITION BY h) END AS canonical_id FROM (SELECT DISTINCT id, {digits_sql('package_hash')} AS h FROM packages))"""


@_query(f"WITH {_K} SELECT id, package_hash, canonical_id, canonical_id <> id AS is_clone FROM k")
def canonical_packages(spark, sf):
    return C.canonical_packages(_packages(spark, sf))


@_query(f"WITH {_K} SELECT canonical_id, id AS clone_id FROM k WHERE id <> canonical_id")
def clones_of(spark, sf):
    """The clones of every canonical package, a row each, as one may have any number of them."""
    return C.canonical_packages(_packages(spark, sf)).where("is_clone").select("canonical_id", F.col("id").alias("clone_id"))


@_query(f"WITH {_B} SELECT count(*) AS n FROM b")
def count_blobs(spark, sf):
    return C.blobs(_content(spark, sf)).agg(F.count("*").alias("n"))


@_query(f'WITH {_B} SELECT h AS content_hash, size, segment_id, "offset", epoch_us(first_seen_at) AS first_seen FROM b ORDER BY first_seen_at')
def blob_scan(spark, sf):
    return C.blobs(_content(spark, sf)).orderBy("first_seen_at").select("content_hash", "size", "segment_id", "offset", F.unix_micros("first_seen_at").alias("first_seen"))


@_query(f"""WITH {_B} SELECT coalesce(sum(size), 0)::BIGINT AS logical_bytes, coalesce(sum(CASE WHEN stored_size > 0 THEN stored_size ELSE size END), 0)::BIGINT AS stored_bytes,
coalesce(sum(size::BIGINT * ref_count), 0)::BIGINT AS referenced_bytes FROM b""")
def blob_byte_totals(spark, sf):
    return C.flat_totals(_content(spark, sf))


@_query(f"""WITH {_B}, t AS (SELECT sum(size)::DOUBLE AS l, sum(CASE WHEN stored_size > 0 THEN stored_size ELSE size END)::DOUBLE AS s, sum(size::BIGINT * ref_count)::DOUBLE AS r FROM b)
SELECT round(l / s, 6) AS compression_ratio, round(greatest(0, (1 - s / l) * 100), 6) AS savings_percent, round(r / s, 6) AS efficiency FROM t""")
def compression_kpis(spark, sf):
    """Compression and storage efficiency, the stored bytes standing for the segments' size."""
    k = C.kpis(C.flat_totals(_content(spark, sf)), F.col("stored_bytes"))
    return k.select(*(F.round(c, 6).alias(c) for c in ("compression_ratio", "savings_percent", "efficiency")))


@_query(f"WITH {_F}, {_B}, c AS (SELECT h, count(*) AS n FROM (SELECT DISTINCT id, h FROM f) GROUP BY h) SELECT b.h AS content_hash, coalesce(n, 0) AS ref_count, ref_count AS was FROM b LEFT JOIN c ON b.h = c.h")
def recompute_refcounts(spark, sf):
    return C.recompute_refcounts(_content(spark, sf), _files(spark, sf))


@_query(f"WITH {_F}, {_B} SELECT f.id, f.package_id, f.h AS blob_hash, f.role, f.original_filename, f.sequence_number, b.size FROM f JOIN b ON f.h = b.h")
def package_files_join(spark, sf):
    return C.files_with_blobs(_files(spark, sf), _content(spark, sf)).select("id", "package_id", "blob_hash", "role", "original_filename", "sequence_number", "size")


@_query(f"WITH {_F}, {_B} SELECT f.package_id, f.id AS file_id, b.segment_id, b.\"offset\", b.size FROM f JOIN b ON f.h = b.h JOIN (SELECT DISTINCT package_id, f.file_id FROM (SELECT package_id, unnest(files) AS f FROM journal) WHERE f IS NOT NULL) j ON j.package_id = f.package_id AND j.file_id = f.id")
def file_lookup_join(spark, sf):
    """The place of every file that the journal names by package and file id."""
    asked = table(spark, sf, "journal", "package_id", "files").select("package_id", F.explode("files.file_id").alias("id")).where(F.col("id").isNotNull()).distinct()
    return C.files_with_blobs(_files(spark, sf), _content(spark, sf)).join(asked, ["package_id", "id"]).select("package_id", F.col("id").alias("file_id"), "segment_id", "offset", "size")


@_query(f"WITH {_F}, {_B} SELECT f.package_id, f.id AS file_id, f.h AS blob_hash, b.size FROM f JOIN b ON f.h = b.h WHERE f.role = 'original'")
def original_file_join(spark, sf):
    files = _files(spark, sf).where(F.col("role") == "original")
    return C.files_with_blobs(files, _content(spark, sf)).select("package_id", F.col("id").alias("file_id"), "blob_hash", "size")


@_query(f"""WITH {_F}, {_B}, {_P}, x AS (SELECT f.package_id, count(*) AS n, sum(b.size)::BIGINT AS s, string_agg(f.id::VARCHAR, ',' ORDER BY f.id) AS ids FROM f JOIN b ON f.h = b.h GROUP BY f.package_id)
SELECT p.id AS package_id, p.supplier_id, p.storage_mode, coalesce(n, 0) AS n_files, coalesce(s, 0) AS n_bytes, coalesce(ids, '') AS file_ids FROM (SELECT DISTINCT id, supplier_id, storage_mode FROM p) p LEFT JOIN x ON x.package_id = p.id""")
def package_manifest(spark, sf):
    m = C.manifests(_packages(spark, sf), _files(spark, sf), _content(spark, sf))
    return m.select("package_id", "supplier_id", "storage_mode", F.col("n_files").cast("long").alias("n_files"), "n_bytes", _joined("files", "file_id").alias("file_ids"))


@_query(f"""WITH {_F}, {_B}, {_P}, s AS (SELECT lower(hex(hash)) AS h, min(entry_no) AS entry_no FROM segment_index WHERE hash IS NOT NULL GROUP BY 1)
SELECT p.id AS package_id, f.id AS file_id, b.segment_id, b."offset", s.entry_no FROM (SELECT DISTINCT id FROM p) p JOIN f ON f.package_id = p.id JOIN b ON b.h = f.h JOIN s ON s.h = b.h""")
def file_location_chain(spark, sf):
    """From package to file to blob to the first index entry of its hash."""
    known = C.files_with_blobs(_files(spark, sf), _content(spark, sf)).join(_packages(spark, sf).select(F.col("id").alias("package_id")).distinct(), "package_id")
    s = table(spark, sf, "segment_index", "hash", "entry_no").where(F.col("hash").isNotNull())
    s = s.groupBy(F.lower(F.hex("hash")).alias("blob_hash")).agg(F.min("entry_no").alias("entry_no"))
    return known.join(s, "blob_hash").select("package_id", F.col("id").alias("file_id"), "segment_id", "offset", "entry_no")


@_query(f"WITH {_K}, {_F} SELECT k.id AS package_id, f.role, f.sequence_number, f.original_filename, f.h AS blob_hash FROM k JOIN f ON f.package_id = k.canonical_id WHERE k.id <> k.canonical_id")
def clone_expand(spark, sf):
    return C.expand_clones(_packages(spark, sf), _files(spark, sf))


@_query(f"""WITH {_K}, {_F}, m AS (SELECT DISTINCT package_id, role, coalesce(sequence_number, -1) AS sequence_number, coalesce(original_filename, '') AS original_filename, coalesce(h, '') AS blob_hash FROM f WHERE role IN ('member', 'unpack_error'))
SELECT k.id AS package_id, role, sequence_number, original_filename, blob_hash FROM k JOIN m ON m.package_id = k.canonical_id WHERE k.id <> k.canonical_id EXCEPT SELECT * FROM m""")
def clone_propagation_anti(spark, sf):
    return C.missing_clone_files(_packages(spark, sf), _files(spark, sf))


_COUNTERS = f"""{_K}, {_F}, {_P}, r AS (SELECT DISTINCT id, package_id, h FROM f WHERE h IS NOT NULL), w AS (SELECT id, package_id, id = min(id) OVER (PARTITION BY h) AS first FROM r),
c AS (SELECT package_id, count(*) FILTER (WHERE first) AS n, count(*) FILTER (WHERE NOT first) AS d FROM w GROUP BY 1),
counters AS (SELECT p.id, p.supplier_id, p.received_at, coalesce(p.file_count, 0) AS file_count, CASE WHEN k.id <> k.canonical_id THEN 0 ELSE coalesce(n, 0) END AS new_refs,
 CASE WHEN k.id <> k.canonical_id THEN coalesce(p.file_count, 0) ELSE coalesce(d, 0) END AS duplicate_refs
 FROM (SELECT DISTINCT id, supplier_id, received_at, file_count FROM p) p JOIN k ON k.id = p.id LEFT JOIN c ON c.package_id = p.id)"""
_STATS = f"""{_COUNTERS}, stats AS (SELECT supplier_id, count(*) AS total_packages, sum(file_count)::BIGINT AS total_refs, sum(duplicate_refs)::BIGINT AS duplicate_refs, max(received_at) AS last_activity FROM counters GROUP BY 1)"""


def _counters(spark, sf):
    return C.ingest_counters(_packages(spark, sf), _files(spark, sf))


@_query(f"WITH {_COUNTERS} SELECT id, supplier_id, file_count, new_refs, duplicate_refs FROM counters")
def ingest_counters(spark, sf):
    return _counters(spark, sf).drop("received_at")


@_query(f"WITH {_STATS} SELECT supplier_id, total_packages, total_refs, duplicate_refs, epoch_us(last_activity) AS last_activity FROM stats")
def supplier_stats(spark, sf):
    return C.supplier_stats(_counters(spark, sf)).drop("dedup_ratio").withColumn("last_activity", F.unix_micros("last_activity"))


@_query(f"WITH {_STATS} SELECT supplier_id, round(CASE WHEN total_refs = 0 THEN 0 ELSE duplicate_refs / total_refs END, 6) AS dedup_ratio FROM stats")
def supplier_dedup_ratio(spark, sf):
    return C.supplier_stats(_counters(spark, sf)).select("supplier_id", F.round("dedup_ratio", 6).alias("dedup_ratio"))


@_query("SELECT id, package_id, row_number() OVER (PARTITION BY package_id ORDER BY id) - 1 AS position FROM (SELECT DISTINCT id, package_id FROM package_files WHERE role = 'member' AND coalesce(original_filename, '') NOT LIKE '%..%' AND package_id IS NOT NULL)")
def member_sequence(spark, sf):
    return C.member_sequence(_files(spark, sf)).withColumn("position", F.col("position").cast("long"))


@_query("SELECT id FROM packages WHERE storage_mode = 'raw_large' AND canonical_package_id IS NULL GROUP BY id ORDER BY id")
def pending_large(spark, sf):
    return _packages(spark, sf).where((F.col("storage_mode") == "raw_large") & F.col("canonical_package_id").isNull()).select("id").distinct().orderBy("id")


@_query(f"WITH {_B}, s AS (SELECT DISTINCT lower(hex(hash)) AS h FROM segment_index WHERE hash IS NOT NULL) SELECT s.h AS hash, b.h IS NOT NULL AS known, b.size, b.ref_count FROM s LEFT JOIN b ON s.h = b.h")
def blob_lookup(spark, sf):
    """For every hash of the segment index: whether the catalog knows it, and its row there."""
    asked = table(spark, sf, "segment_index", "hash").where(F.col("hash").isNotNull()).select(F.lower(F.hex("hash")).alias("hash")).distinct()
    b = C.blobs(_content(spark, sf)).select("content_hash", "size", "ref_count")
    return asked.join(b, asked["hash"] == b["content_hash"], "left").select("hash", F.col("content_hash").isNotNull().alias("known"), "size", "ref_count")


@_query(f"""WITH {_B}, {_F}, n AS (SELECT DISTINCT h FROM f WHERE h IS NOT NULL) SELECT n.h AS content_hash, b.segment_id, b."offset", b.size FROM n JOIN b ON n.h = b.h""")
def stored_index(spark, sf):
    """The hot index stored in buckets by hash, in two batches, and looked up for the hashes that files name."""
    store = BucketStore(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "content_hash string, segment_id int, offset long, size int", "content_hash", 32)
    rows = C.blobs(_content(spark, sf)).select("content_hash", "segment_id", "offset", "size")
    half = F.crc32(F.encode("content_hash", "utf-8")) % 2 == 0
    store.put(rows.where(half), 0)
    store.put(rows.where(~half), 1)
    found = cut(store.get(C.named(_files(spark, sf)).select("blob_hash")))
    store.truncate()
    return found


@_query(f"WITH {_B}, {_F} SELECT DISTINCT f.h AS blob_hash FROM f WHERE h IS NOT NULL AND h NOT IN (SELECT h FROM b)")
def new_vs_existing_blobs(spark, sf):
    """The hashes that files name and the catalog lacks: those a Bloom filter rules out, and of the others those an exact lookup does."""
    named = C.named(_files(spark, sf)).withColumn("key", F.xxhash64("blob_hash"))
    b = C.blobs(_content(spark, sf)).select("content_hash")
    gated = cut(might_contain(named, "key", bloom_index(b, F.xxhash64("content_hash"))))
    maybe = gated.where("maybe").select("blob_hash")
    return gated.where("NOT maybe").select("blob_hash").unionByName(maybe.join(b, maybe["blob_hash"] == b["content_hash"], "left_anti"))


@_query(f"WITH {_B}, {_F}, n AS (SELECT DISTINCT h, h IN (SELECT h FROM b) AS known FROM f WHERE h IS NOT NULL) SELECT count(*) AS n_asked, count(*) FILTER (WHERE known) AS n_known, 0::BIGINT AS n_missed, true AS within FROM n")
def bloom_gate(spark, sf):
    """The gate held against exact lookups: known hashes it missed, and whether it let no more through than three times its rate and ten."""
    named = C.named(_files(spark, sf)).withColumn("key", F.xxhash64("blob_hash"))
    b = C.blobs(_content(spark, sf)).select("content_hash")
    gated = might_contain(named, "key", bloom_index(b, F.xxhash64("content_hash"), 0.01))
    known = F.col("content_hash").isNotNull()
    both = gated.join(b, gated["blob_hash"] == b["content_hash"], "left")
    sums = both.agg(F.count("*").alias("n_asked"), F.count_if(known).alias("n_known"), F.count_if(known & ~F.col("maybe")).alias("n_missed"), F.count_if(~known & F.col("maybe")).alias("n_false"))
    return sums.select("n_asked", "n_known", "n_missed", (F.col("n_false") <= 10 + 0.03 * (F.col("n_asked") - F.col("n_known"))).alias("within"))


@_query(f'WITH {_B} SELECT h AS content_hash, segment_id, "offset", size FROM b')
def dedup_index(spark, sf):
    """The hot index, made anew from the catalog: one entry of place and size a hash."""
    return C.blobs(_content(spark, sf)).select("content_hash", "segment_id", "offset", "size")


@_query("SELECT arg_max(line_no, line_no) AS line_no, package_id, arg_max(file_count, line_no) AS file_count, len(arg_max({'f': files}, line_no).f) AS n_files FROM journal WHERE package_id IS NOT NULL GROUP BY package_id")
def journal_latest(spark, sf):
    j = C.journal_latest(table(spark, sf, "journal"))
    return j.select("line_no", "package_id", "file_count", F.when(F.col("files").isNotNull(), F.size("files")).cast("long").alias("n_files"))


@_query("SELECT line_no, package_id, f.file_id, f.role, f.sequence_number FROM (SELECT line_no, package_id, unnest(files) AS f FROM journal) WHERE f IS NOT NULL")
def journal_explode(spark, sf):
    j = table(spark, sf, "journal", "line_no", "package_id", "files").select("line_no", "package_id", F.explode("files").alias("f"))
    return j.where(F.col("f").isNotNull()).select("line_no", "package_id", "f.file_id", "f.role", "f.sequence_number")


@_query(f"""WITH {_P}, {_F}, x AS (SELECT package_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT id, package_id FROM f) GROUP BY 1)
SELECT p.id AS package_id, strftime(p.received_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ') AS received_at, coalesce(n, 0) AS n_files, coalesce(ids, '') AS file_ids FROM (SELECT DISTINCT id, received_at FROM p) p LEFT JOIN x ON x.package_id = p.id""")
def journal_snapshot(spark, sf):
    """The journal line of every package as it is now, read back."""
    from catalith.sources.journal import snapshot_lines, parse_lines

    lines = snapshot_lines(_packages(spark, sf), _files(spark, sf))
    back = parse_lines(lines)
    return back.select("package_id", "received_at", F.size("files").cast("long").alias("n_files"), _joined("files", "file_id").alias("file_ids"))


@_query(f"SELECT doc_id, sha256(text) AS content_hash, strlen(text) AS n_bytes FROM documents WHERE text IS NOT NULL")
def content_hash(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    return d.select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("content_hash"), F.octet_length("text").cast("long").alias("n_bytes"))


@_query("SELECT source, sha256(text) AS content_hash, arg_min(doc_id, (created_at IS NULL, created_at, doc_id)) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def first_seen_blobs(spark, sf):
    """The document that brought each text first, within its source."""
    d = table(spark, sf, "documents", "doc_id", "source", "text", "created_at").where(F.col("text").isNotNull())
    h = d.select("doc_id", "source", F.sha2(F.encode("text", "utf-8"), 256).alias("content_hash"), "created_at")
    rank = F.struct(F.col("created_at").isNull().alias("n"), "created_at", "doc_id")
    return h.groupBy("source", "content_hash").agg(F.min_by("doc_id", rank).alias("doc_id"), F.count("*").alias("n"))


_GO_SPACE = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TYPE = f"CASE WHEN strlen(text) < 4 THEN 'too_small' WHEN starts_with(text, 'PK') THEN 'zip' WHEN regexp_matches(text, '^{_GO_SPACE}*<') THEN 'xml' WHEN text IS NOT NULL THEN 'unsupported' END"


_KINDS = "(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PK' || text WHEN 1 THEN ' ' || chr(10) || chr(8195) || '<' || text ELSE text END AS text FROM documents)"


@_query(f"SELECT doc_id, {_TYPE} AS payload_type FROM {_KINDS}")
def detect_payload(spark, sf):
    """What each text is taken for, a quarter of them made to begin like archives and a quarter like XML."""
    d = table(spark, sf, "documents", "doc_id", "text")
    turn = F.col("doc_id") % 4
    body = F.when(turn == 0, F.concat(F.lit("PK"), "text")).when(turn == 1, F.concat(F.lit(" \n\u2003<"), "text")).otherwise(F.col("text"))
    return d.select("doc_id", P.payload_type(body).alias("payload_type"))


@_query(f"""SELECT doc_id, CASE WHEN s IS NULL THEN 'missing' WHEN s NOT BETWEEN 1 AND 1000000 THEN 'out_of_range' WHEN coalesce(strlen(text), 0) = 0 THEN 'empty' WHEN strlen(text) > 20000 THEN 'too_large'
WHEN k IN ('too_small', 'unsupported') THEN k END AS reason, CASE WHEN s BETWEEN 1 AND 1000000 THEN s END AS supplier_id FROM (SELECT doc_id, text, author_id AS s, {_TYPE} AS k FROM documents)""")
def ingest_validation(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "author_id", "text")
    return P.validate_uploads(d, "author_id", "text", 20_000).select("doc_id", "reason", F.col("supplier_id").cast("long").alias("supplier_id"))


@_query(f"WITH {_P} SELECT id, CASE WHEN sz > 20000 OR coalesce(file_count, 0) - 1 > 20 THEN 'raw_large' ELSE 'zip_with_members' END AS route FROM (SELECT DISTINCT p.id, p.file_count, coalesce(t.sz, 0) AS sz FROM p LEFT JOIN (WITH {_F}, {_B} SELECT package_id, sum(size) AS sz FROM f JOIN b ON f.h = b.h WHERE role = 'original' GROUP BY 1) t ON t.package_id = p.id WHERE p.payload_type = 'zip')")
def zip_routing(spark, sf):
    """Archives of more than 20,000 bytes or 20 members are kept whole (limits of the query: the test tables have few larger ones)."""
    own = C.files_with_blobs(_files(spark, sf).where(F.col("role") == "original"), _content(spark, sf)).groupBy("package_id").agg(F.sum("size").alias("sz"))
    zips = _packages(spark, sf).where(F.col("payload_type") == "zip").select("id", "file_count").distinct()
    both = zips.join(own, zips["id"] == own["package_id"], "left")
    return both.select("id", P.archive_route(F.coalesce("sz", F.lit(0)), F.col("file_count") - 1, 20_000, 20).alias("route"))


@_query("SELECT DISTINCT id, CASE WHEN role = 'unpack_error' THEN 'text/plain; charset=utf-8' WHEN lower(coalesce(original_filename, '')) LIKE '%.xml' THEN 'application/xml' WHEN lower(coalesce(original_filename, '')) LIKE '%.zip' THEN 'application/zip' ELSE 'application/octet-stream' END AS content_type FROM package_files")
def content_type(spark, sf):
    return _files(spark, sf).select("id", P.content_type(F.col("role"), F.col("original_filename")).alias("content_type")).distinct()


@_query("""SELECT DISTINCT id, CASE WHEN storage_mode = 'raw_large' THEN 'pending' WHEN storage_mode = 'zip_with_members' THEN CASE WHEN unpack_error IS NULL THEN 'ok' ELSE 'failed' END END AS unpack_status,
'/v1/packages/' || id || '/original' AS link FROM packages WHERE id IS NOT NULL""")
def unpack_status(spark, sf):
    p = _packages(spark, sf).where(F.col("id").isNotNull())
    done = F.when(F.col("unpack_error").isNull(), "ok").otherwise("failed")
    status = F.when(F.col("storage_mode") == "raw_large", "pending").when(F.col("storage_mode") == "zip_with_members", done)
    return p.select("id", status.alias("unpack_status"), F.format_string("/v1/packages/%d/original", "id").alias("link")).distinct()


@_query("SELECT DISTINCT name, regexp_matches(name, '^[0-9]+(-[0-9]+)?$') AS is_folder, try_cast(nullif(regexp_extract(name, '^([0-9]+)(-[0-9]+)?$', 1), '') AS INT) AS supplier FROM (SELECT split_part(original_filename, '/', 1) AS name FROM package_files WHERE original_filename IS NOT NULL)")
def org_to_supplier(spark, sf):
    names = _files(spark, sf).where(F.col("original_filename").isNotNull()).select(F.split_part("original_filename", F.lit("/"), F.lit(1)).alias("name")).distinct()
    return names.select("name", F.col("name").rlike("^[0-9]+(-[0-9]+)?$").alias("is_folder"), P.folder_supplier(F.col("name")).alias("supplier"))


_HEX = "(SELECT DISTINCT doc_id, md5(text) AS m FROM documents WHERE text IS NOT NULL)"


@_query(f"SELECT doc_id, u, regexp_matches(u, '(?i)^[0-9a-f]{{8}}-([0-9a-f]{{4}}-){{3}}[0-9a-f]{{12}}$') AS valid FROM (SELECT doc_id, CASE WHEN m < '8' THEN substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) ELSE m END AS u FROM {_HEX})")
def uuid_valid(spark, sf):
    """Ids made of the texts' digests, half of them written as UUIDs."""
    m = table(spark, sf, "documents", "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", F.md5(F.encode("text", "utf-8")).alias("m"))
    parts = F.concat_ws("-", *(F.substring("m", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    u = F.when(F.col("m") < "8", parts).otherwise(F.col("m"))
    return m.select("doc_id", u.alias("u"), P.is_uuid(u).alias("valid"))


@_query("SELECT doc_id, doc_id % 3 = 0 AS is_frame FROM documents WHERE text IS NOT NULL")
def zstd_magic(spark, sf):
    """Which texts are frames: a third of them were made to begin like one, another third almost."""
    d = table(spark, sf, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    head = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("28B52FFD"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("28B52FFC"))).otherwise(F.unhex(F.lit("28B52F")))
    return d.select("doc_id", P.is_zstd(F.concat(head, F.encode("text", "utf-8"))).alias("is_frame"))


@_query("SELECT entry_no, lower(hex(hash)) AS digits, true AS same FROM segment_index WHERE hash IS NOT NULL")
def hex_roundtrip(spark, sf):
    s = table(spark, sf, "segment_index", "entry_no", "hash").where(F.col("hash").isNotNull())
    digits = F.lower(F.hex("hash"))
    return s.select("entry_no", digits.alias("digits"), (F.unhex(digits) == F.col("hash")).alias("same"))


@_query("SELECT line_no, epoch_us(received_at::TIMESTAMPTZ) AS micros, strftime(received_at::TIMESTAMPTZ AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ') AS written FROM journal")
def ts_roundtrip(spark, sf):
    """Times, however they are written, as microseconds, and written alike."""
    t = F.col("received_at").try_cast("timestamp")
    return table(spark, sf, "journal", "line_no", "received_at").select("line_no", F.unix_micros(t).alias("micros"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("written"))


@_query("SELECT supplier_id, strftime(received_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_packages, count(DISTINCT package_hash) AS n_hashes FROM (SELECT DISTINCT id, supplier_id, received_at, " + digits_sql("package_hash") + " AS package_hash FROM packages) GROUP BY 1, 2")
def supplier_period(spark, sf):
    """What each supplier sent in each month."""
    p = C.clean(_packages(spark, sf).select("id", "supplier_id", "received_at", "package_hash"), "package_hash")
    return p.groupBy("supplier_id", utc_month(F.col("received_at")).alias("month")).agg(F.count("*").alias("n_packages"), F.count_distinct("package_hash").alias("n_hashes"))


@_query(f"""WITH {_K}, {_P} SELECT hour(received_at AT TIME ZONE 'UTC') AS hour, count(*) AS n_packages, round(avg(CASE WHEN k.id <> k.canonical_id THEN 1.0 ELSE 0.0 END), 6) AS duplicate_rate, round(avg(file_count), 6) AS mean_files
FROM (SELECT DISTINCT id, received_at, file_count FROM p) p JOIN k ON k.id = p.id GROUP BY 1""")
def business_kpis(spark, sf):
    """Packages, duplicate rate and mean size by hour of the day."""
    p = _packages(spark, sf).select("id", "received_at", "file_count").distinct().join(C.canonical_packages(_packages(spark, sf)).select("id", "is_clone"), "id")
    return p.groupBy(F.hour("received_at").cast("long").alias("hour")).agg(
        F.count("*").alias("n_packages"), F.round(F.avg(F.col("is_clone").cast("double")), 6).alias("duplicate_rate"), F.round(F.avg("file_count"), 6).alias("mean_files")
    )


@_query("SELECT count(DISTINCT id) AS n_packages, coalesce(max(id), 1) AS last_id FROM packages")
def next_ids(spark, sf):
    """Where the ids of new packages go on."""
    return _packages(spark, sf).agg(F.count_distinct("id").alias("n_packages"), F.coalesce(F.max("id"), F.lit(1)).alias("last_id"))

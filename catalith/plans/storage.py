"""Queries over segments, shards, merges and request metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.hashes import digits_sql
from catalith.operators import catalog as C
from catalith.operators import merge as M
from catalith.operators import metrics as X
from catalith.operators import ordered as O
from catalith.operators import shards as S
from catalith.plans.catalog import _B, _content, _files, _packages
from catalith.session import cut, remove, shared_dir
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


def _listing(spark: SparkSession, sf: str, side: str = "primary") -> DataFrame:
    return table(spark, sf, f"segment_files_{side}")


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    return S.registry(_listing(spark, sf), _listing(spark, sf, "replica"))


def _index(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "segment_index", *columns)


_T = "t AS (SELECT shard_id, count(*) AS n_files, coalesce(sum(size), 0)::BIGINT AS total_bytes, max(modified_unix) AS last_modified FROM (SELECT DISTINCT shard_id, name, size, modified_unix FROM segment_files_primary) GROUP BY 1)"
_R = f"{_T}, r AS (SELECT *, CASE WHEN shard_id = (SELECT max(shard_id) FROM t) THEN 'active' ELSE 'sealed' END AS state, shard_id IN (SELECT shard_id FROM segment_files_replica) AS has_replica FROM t)"


@_query(f"WITH {_T} SELECT * FROM t")
def segment_total_bytes(spark, sf):
    return S.shard_totals(_listing(spark, sf))


@_query(f"WITH {_R} SELECT shard_id, total_bytes, state, has_replica FROM r")
def shards_by_state(spark, sf):
    return _registry(spark, sf).select("shard_id", "total_bytes", "state", "has_replica")


@_query(f"WITH {_R} SELECT shard_id, CASE WHEN state = 'sealed' AND has_replica THEN 'replica' ELSE 'primary' END AS route FROM r")
def read_route(spark, sf):
    return _registry(spark, sf).select("shard_id", S.read_route(F.col("state"), F.col("has_replica")).alias("route"))


@_query(f"WITH {_R} SELECT count(*) AS n_shards, sum(total_bytes)::BIGINT AS total_bytes, coalesce(max(CASE WHEN state = 'active' THEN shard_id END), -1) AS active_shard, count(*) FILTER (WHERE has_replica) AS n_replicated FROM r")
def shard_gauges(spark, sf):
    active = F.coalesce(F.max(F.when(F.col("state") == "active", F.col("shard_id"))), F.lit(-1))
    return _registry(spark, sf).agg(F.count("*").alias("n_shards"), F.sum("total_bytes").alias("total_bytes"), active.alias("active_shard"), F.count_if("has_replica").alias("n_replicated"))


@_query(f"WITH {_T} SELECT * FROM (SELECT shard_id, total_bytes FROM t ORDER BY shard_id DESC LIMIT 4) ORDER BY shard_id")
def last4_shards(spark, sf):
    """The four newest shards (the limit is the report's)."""
    return S.shard_totals(_listing(spark, sf)).select("shard_id", "total_bytes").orderBy(F.desc("shard_id")).limit(4).orderBy("shard_id")


@_query("SELECT coalesce(max(shard_id), -1) + 1 AS next_shard_id FROM segment_files_primary")
def next_shard_id(spark, sf):
    return _listing(spark, sf).agg((F.coalesce(F.max("shard_id"), F.lit(-1)) + 1).alias("next_shard_id"))


@_query(f"WITH {_T} SELECT shard_id, round(100.0 * total_bytes / (SELECT max(total_bytes) FROM t), 6) AS fill_pct FROM t ORDER BY shard_id")
def shard_fill_pct(spark, sf):
    totals = S.shard_totals(_listing(spark, sf))
    most = F.broadcast(totals.agg(F.max("total_bytes").alias("most")))  # one row
    return totals.join(most).select("shard_id", F.round(100.0 * F.col("total_bytes") / F.col("most"), 6).alias("fill_pct")).orderBy("shard_id")


@_query(f"WITH {_R} SELECT DISTINCT shard_id, name, size FROM segment_files_primary WHERE shard_id IN (SELECT shard_id FROM r WHERE state = 'active')")
def active_shard_semi(spark, sf):
    active = _registry(spark, sf).where(F.col("state") == "active")
    return _listing(spark, sf).select("shard_id", "name", "size").distinct().join(active, "shard_id", "left_semi")


@_query(f"WITH {_T} SELECT shard_id, total_bytes, total_bytes >= (SELECT (sum(total_bytes) // count(*))::BIGINT FROM t) AS due FROM t")
def seal_due(spark, sf):
    """Which shards have reached the size at which they are sealed, here the mean of all."""
    totals = S.shard_totals(_listing(spark, sf))
    mean = F.broadcast(totals.agg(F.expr("sum(total_bytes) div count(*)").alias("mean")))  # one row
    return totals.join(mean).select("shard_id", "total_bytes", S.seal_due(F.col("total_bytes"), F.col("mean")).alias("due"))


@_query(f"WITH {_T} SELECT min((SELECT max(total_bytes) FROM t) - total_bytes)::BIGINT AS min_free, count(*) AS n FROM t WHERE shard_id < (SELECT max(shard_id) FROM t)")
def min_free(spark, sf):
    """The least room left, the fullest shard being the capacity of each but the newest."""
    totals = S.shard_totals(_listing(spark, sf))
    most = F.broadcast(totals.agg(F.max("total_bytes").alias("most"), F.max("shard_id").alias("newest")))  # one row
    older = totals.join(most).where(F.col("shard_id") < F.col("newest"))
    return older.agg(F.min(F.col("most") - F.col("total_bytes")).alias("min_free"), F.count("*").alias("n"))


@_query("SELECT shard_id, count(*) AS n_lines FROM raw_journal GROUP BY 1")
def uploads_by_shard(spark, sf):
    return table(spark, sf, "raw_journal", "shard_id").groupBy("shard_id").agg(F.count("*").alias("n_lines"))


@_query("SELECT line_no, (shard_id::BIGINT << 48) | line_no AS gid, shard_id AS shard, line_no AS local FROM raw_journal WHERE shard_id IS NOT NULL")
def global_id_codec(spark, sf):
    r = table(spark, sf, "raw_journal", "line_no", "shard_id").where(F.col("shard_id").isNotNull())
    gid = r.select("line_no", S.global_id(F.col("shard_id"), F.col("line_no")).alias("gid"))
    return gid.select("line_no", "gid", S.shard_of(F.col("gid")).alias("shard"), S.local_of(F.col("gid")).alias("local"))


@_query(f"WITH {_R} SELECT j.line_no, j.shard_id, r.state, r.shard_id IS NOT NULL AS found FROM raw_journal j LEFT JOIN r ON r.shard_id = j.shard_id WHERE j.shard_id IS NOT NULL")
def route_global_id(spark, sf):
    """The shard each global id leads to, where there is one."""
    gid = global_id_codec(spark, sf).select("line_no", "gid")
    reg = _registry(spark, sf).select("shard_id", "state")
    return gid.join(reg, S.shard_of(F.col("gid")) == F.col("shard_id"), "left").select("line_no", S.shard_of(F.col("gid")).alias("shard_id"), "state", F.col("shard_id").isNotNull().alias("found"))


@_query(f"WITH {_B}, s AS (SELECT lower(hex(hash)) AS h, arg_min(segment_id, entry_no) AS seg FROM segment_index WHERE hash IS NOT NULL GROUP BY 1) SELECT b.h AS content_hash, s.seg AS found_in FROM b LEFT JOIN s ON b.h = s.h")
def xml_hash_route(spark, sf):
    """The segment in which each blob's hash was indexed first."""
    s = _index(spark, sf, "hash", "segment_id", "entry_no").where(F.col("hash").isNotNull())
    first = s.groupBy(F.lower(F.hex("hash")).alias("h")).agg(F.min_by("segment_id", "entry_no").alias("found_in"))
    b = C.blobs(_content(spark, sf)).select("content_hash")
    return b.join(first, b["content_hash"] == first["h"], "left").select("content_hash", "found_in")


@_query("SELECT DISTINCT p.shard_id, p.name FROM (SELECT DISTINCT shard_id, name, size, " + digits_sql("sha256") + " AS h FROM segment_files_primary) p LEFT JOIN (SELECT DISTINCT shard_id, name, size, " + digits_sql("sha256") + " AS h, true AS there FROM segment_files_replica) q ON p.shard_id = q.shard_id AND p.name = q.name WHERE q.there IS NULL OR p.size IS DISTINCT FROM q.size OR p.h IS DISTINCT FROM q.h")
def sync_diff(spark, sf):
    """The files the replica has to fetch."""
    side = lambda x: C.clean(_listing(spark, sf, x).select("shard_id", "name", "size", "sha256"), "sha256")
    a, b = side("primary"), side("replica").withColumnsRenamed({"size": "size_b", "sha256": "sha_b"}).withColumn("there", F.lit(True))
    same = F.col("size").eqNullSafe(F.col("size_b")) & F.col("sha256").eqNullSafe(F.col("sha_b"))
    return a.join(b, ["shard_id", "name"], "left").where(F.col("there").isNull() | ~same).select("shard_id", "name").distinct()


@_query(f'WITH {_B} SELECT h AS content_hash, size + 12 AS record_bytes, stored_size > 0 AND stored_size < size + 12 AS is_smaller FROM b')
def stored_size(spark, sf):
    """What a record of each blob takes uncompressed, and whether the stored one is smaller."""
    b = C.blobs(_content(spark, sf))
    plain = F.col("size") + O.RECORD_OVERHEAD
    return b.select("content_hash", plain.alias("record_bytes"), ((F.col("stored_size") > 0) & (F.col("stored_size") < plain)).alias("is_smaller"))


@_query("SELECT entry_no, segment_id, coalesce(sum(coalesce(stored_size, 0)) OVER (PARTITION BY segment_id ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS running_offset FROM segment_index")
def running_offsets(spark, sf):
    return O.running_offsets(_index(spark, sf, "entry_no", "segment_id", "stored_size"), "segment_id", "entry_no", F.col("stored_size")).drop("stored_size")


_MAGIC = ", ".join(str(m) for m in O.MAGIC.values())


@_query(f"""SELECT entry_no, segment_id, min(coalesce(magic IN ({_MAGIC}) AND stored_size > 0 AND hash IS NOT NULL, false)) OVER (PARTITION BY segment_id ORDER BY "offset", entry_no ROWS UNBOUNDED PRECEDING) AS kept FROM segment_index""")
def valid_prefix(spark, sf):
    """Which entries of each segment come before the first damaged one."""
    good = F.col("magic").isin(*O.MAGIC.values()) & (F.col("stored_size") > 0) & F.col("hash").isNotNull()
    rows = _index(spark, sf, "entry_no", "segment_id", "offset", "magic", "stored_size", "hash")
    return O.valid_prefix(rows, "segment_id", ["offset", "entry_no"], good).select("entry_no", "segment_id", "kept")


@_query("SELECT doc_id, strlen(text) AS n_bytes, sha256(text) AS digest, true AS crc_ok FROM documents WHERE text IS NOT NULL")
def point_read(spark, sf):
    """Every text stored once in the segments of four shards, then read for each document by hash, index and place."""
    from catalith.sources.segments import read_places, store_contents

    d = table(spark, sf, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    d = d.select("doc_id", F.encode("text", "utf-8").alias("payload")).withColumn("hash", F.unhex(F.sha2("payload", 256)))
    first = d.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    shard = F.pmod(F.crc32("hash"), F.lit(4)).cast("int")
    once = d.join(first, "doc_id", "left_semi").select(shard.alias("shard_id"), F.col("doc_id").alias("order"), F.lit(O.MAGIC["XML1"]).alias("magic"), "payload", "hash", F.lit(1).alias("supplier_id"), F.lit(0).alias("dict_id"))
    path = f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}"
    index = cut(store_contents(once, path, 4 << 20))
    found = read_places(index, path).join(index.select("shard_id", "segment_id", "offset", "hash"), ["shard_id", "segment_id", "offset"])
    read = cut(found.select("hash", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("digest"), "crc_ok"))
    remove(spark, path)
    return d.select("doc_id", "hash").join(read, "hash").select("doc_id", "n_bytes", "digest", "crc_ok")


@_query("SELECT doc_id, strlen(text) AS n_bytes, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def compress_roundtrip(spark, sf):
    """Every text compressed where that makes it smaller, and read back."""
    from catalith.sources.compression import compress, decompress

    d = table(spark, sf, "documents", "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", F.encode("text", "utf-8").alias("raw"))
    back = decompress(compress(d, "raw").select("doc_id", "stored"), "stored")
    return back.select("doc_id", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("digest"))


@_query("""WITH RECURSIVE x AS (SELECT shard_id, line_no, (coalesce(strlen(line), 0) + 12)::BIGINT AS size, row_number() OVER (PARTITION BY shard_id ORDER BY line_no) AS n FROM raw_journal),
r AS (SELECT shard_id, line_no, n, 0 AS segment, 0::BIGINT AS start, size AS used FROM x WHERE n = 1
UNION ALL SELECT x.shard_id, x.line_no, x.n, CASE WHEN r.used + x.size > 65536 - 32 THEN r.segment + 1 ELSE r.segment END, CASE WHEN r.used + x.size > 65536 - 32 THEN 0 ELSE r.used END, CASE WHEN r.used + x.size > 65536 - 32 THEN x.size ELSE r.used + x.size END
FROM r JOIN x ON x.shard_id IS NOT DISTINCT FROM r.shard_id AND x.n = r.n + 1) SELECT shard_id, line_no, segment, start AS "offset" FROM r""")
def segment_packing(spark, sf):
    """The journal lines of each shard, packed into segments of 64 KiB."""
    lines = table(spark, sf, "raw_journal", "shard_id", "line_no", "line")
    sized = lines.select("shard_id", "line_no", (F.coalesce(F.octet_length("line"), F.lit(0)) + O.RECORD_OVERHEAD).alias("size"))
    return O.pack_segments(sized, "shard_id", "line_no", "size", 65_536)


@_query("SELECT package_id, (row_number() OVER (PARTITION BY package_id ORDER BY id) - 1)::INT AS sequence_number, name AS filename, strlen(h) AS n_bytes FROM (SELECT DISTINCT id, package_id, coalesce(original_filename, 'file_' || id) AS name, coalesce(" + digits_sql("blob_hash") + ", '') AS h FROM package_files WHERE role = 'member' AND package_id IS NOT NULL) WHERE name NOT LIKE '%..%' AND name NOT LIKE '%/'")
def zip_members(spark, sf):
    """Every package's members packed into an archive (their digests as contents) and unpacked again."""
    from catalith.sources.segments import archive_members

    out = archive_members(_archives(spark, sf), "package_id", "body").where(F.col("error").isNull())
    return out.select("package_id", "sequence_number", "filename", F.octet_length("data").cast("long").alias("n_bytes"))


def _archives(spark, sf):
    """package_id, body: every package's members packed into an archive, their digests as contents."""
    from catalith.sources.segments import build_archives

    m = C.clean(_files(spark, sf).where((F.col("role") == "member") & F.col("package_id").isNotNull()).select("id", "package_id", "original_filename", "blob_hash"), "blob_hash")
    name = F.coalesce("original_filename", F.concat(F.lit("file_"), F.col("id").cast("string")))
    x = F.struct("id", name.alias("name"), F.encode(F.coalesce("blob_hash", F.lit("")), "utf-8").alias("data"))
    lists = m.groupBy("package_id").agg(F.sort_array(F.collect_list(x)).alias("x"))
    lists = lists.select("package_id", F.transform("x", lambda y: F.struct(y["name"].alias("name"), y["data"].alias("data"))).alias("members"))
    return build_archives(lists, "package_id", "members")


@_query("""WITH RECURSIVE d AS (SELECT doc_id, sha256(text) AS h, coalesce(strlen(text), 0)::BIGINT AS size, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE doc_id IS NOT NULL),
q AS (SELECT greatest(1, coalesce(sum(size), 4) // 4) AS most FROM d),
r AS (SELECT n, doc_id, 0 AS shard, size AS used, CASE WHEN h IS NULL THEN []::VARCHAR[] ELSE [h] END AS met FROM d WHERE n = 1
UNION ALL SELECT d.n, d.doc_id, CASE WHEN r.used >= q.most THEN r.shard + 1 ELSE r.shard END, CASE WHEN r.used >= q.most THEN d.size WHEN d.h IS NULL OR list_contains(r.met, d.h) THEN r.used ELSE r.used + d.size END,
CASE WHEN r.used >= q.most THEN CASE WHEN d.h IS NULL THEN []::VARCHAR[] ELSE [d.h] END WHEN d.h IS NULL OR list_contains(r.met, d.h) THEN r.met ELSE list_append(r.met, d.h) END
FROM r JOIN d ON d.n = r.n + 1, q) SELECT doc_id, shard FROM r""")
def shard_assignment(spark, sf):
    """The documents dealt to shards that are sealed once their different texts have a quarter of all bytes."""
    d = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("h"), F.octet_length("text").alias("size"))
    quarter = (d.agg(F.sum("size")).first()[0] or 4) // 4
    return O.assign_shards(d, "doc_id", "h", "size", max(1, quarter)).select("doc_id", "shard")


@_query()
def crc32_ieee(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.crc32(F.encode("text", "utf-8")).alias("crc"))


@_query("SELECT segment_id, arg_max(dict_id, (dict_id, entry_no)) AS dict_id, arg_max(entry_no, (dict_id, entry_no)) AS entry_no FROM segment_index WHERE dict_id IS NOT NULL GROUP BY 1")
def latest_dictionary(spark, sf):
    """The newest dictionary each segment uses, and the last entry that does."""
    rows = _index(spark, sf, "segment_id", "dict_id", "entry_no").where(F.col("dict_id").isNotNull())
    top = F.max(F.struct("dict_id", "entry_no")).alias("x")
    return rows.groupBy("segment_id").agg(top).select("segment_id", "x.dict_id", "x.entry_no")


@_query(f"""WITH {_B}, e AS (SELECT lower(hex(hash)) AS h, logical_size, segment_id, "offset", entry_no FROM segment_index WHERE hash IS NOT NULL),
n AS (SELECT h, count(*) AS n, arg_min(logical_size, entry_no) AS size, arg_min(segment_id, entry_no) AS segment_id FROM e GROUP BY 1)
SELECT coalesce(b.h, n.h) AS content_hash, CASE WHEN b.h IS NULL THEN n.size ELSE b.size END AS size, CASE WHEN b.h IS NULL THEN n.segment_id ELSE b.segment_id END AS segment_id, coalesce(b.ref_count, 0) + coalesce(n.n, 0) AS ref_count, b.h IS NULL AS inserted FROM b FULL JOIN n ON b.h = n.h""")
def upsert_blobs(spark, sf):
    """The catalog after every index entry was inserted or counted."""
    old = C.blobs(_content(spark, sf)).select("content_hash", F.col("size").cast("long").alias("size"), "segment_id", "ref_count")
    new = _index(spark, sf, "hash", "logical_size", "segment_id", "entry_no").where(F.col("hash").isNotNull())
    new = new.select(F.lower(F.hex("hash")).alias("content_hash"), F.col("logical_size").alias("size"), "segment_id", "entry_no")
    return M.insert_or_increment(old, new, "content_hash", "ref_count", "entry_no", ["size", "segment_id"])


@_query("""WITH p AS (SELECT DISTINCT id, supplier_id, storage_mode, file_count FROM packages), j AS (SELECT package_id AS id, arg_max({'s': supplier_id, 'm': storage_mode, 'c': file_count}, line_no) AS x FROM journal WHERE package_id IS NOT NULL GROUP BY 1)
SELECT coalesce(p.id, j.id) AS id, CASE WHEN j.id IS NULL THEN p.supplier_id ELSE x.s END AS supplier_id, CASE WHEN j.id IS NULL THEN p.storage_mode ELSE x.m END AS storage_mode, CASE WHEN j.id IS NULL THEN p.file_count ELSE x.c END AS file_count FROM p FULL JOIN j ON p.id = j.id""")
def restore_upsert(spark, sf):
    """The packages after the journal was replayed onto them."""
    columns = ["supplier_id", "storage_mode", "file_count"]
    old = _packages(spark, sf).select("id", *columns).distinct()
    new = table(spark, sf, "journal", "package_id", "line_no", *columns).withColumnRenamed("package_id", "id")
    return M.replace_latest(old, new, "id", "line_no", columns)


@_query("""WITH a AS (SELECT shard_id, name, min(sha256) AS s FROM segment_files_replica GROUP BY 1, 2), b AS (SELECT shard_id, name, min(sha256) AS s FROM segment_files_primary GROUP BY 1, 2)
SELECT coalesce(a.shard_id, b.shard_id) AS shard_id, coalesce(a.name, b.name) AS name, coalesce(nullif(trim(a.s), ''), b.s) AS sha256 FROM a FULL JOIN b ON a.shard_id = b.shard_id AND a.name = b.name""")
def bootstrap_merge(spark, sf):
    """The replica's listing, its blanks filled from the primary's, and what it lacks added."""
    side = lambda x, to: _listing(spark, sf, x).groupBy("shard_id", "name").agg(F.min("sha256").alias(to))
    both = side("replica", "mine").join(side("primary", "given"), ["shard_id", "name"], "full")
    return both.select("shard_id", "name", M.fill_blank(F.col("mine"), F.col("given")).alias("sha256"))


@_query("SELECT id, 'packages' AS origin FROM packages WHERE id IS NOT NULL GROUP BY id UNION ALL SELECT DISTINCT package_id, 'journal' FROM journal WHERE package_id NOT IN (SELECT id FROM packages)")
def global_index_append(spark, sf):
    """The ids of packages, and those only the journal has."""
    old = _packages(spark, sf).where(F.col("id").isNotNull()).select("id").distinct().withColumn("origin", F.lit("packages"))
    new = table(spark, sf, "journal", "package_id").where(F.col("package_id").isNotNull()).select(F.col("package_id").alias("id"), F.lit("journal").alias("origin"))
    return M.insert_ignore(old, new, ["id"])


@_query("SELECT id, CASE WHEN storage_mode = 'raw_large' THEN 'zip_with_members' ELSE storage_mode END AS storage_mode, coalesce(storage_mode = 'raw_large', false) AS applied, CASE WHEN storage_mode = 'raw_large' THEN 1 + coalesce(n, 0) ELSE file_count END AS file_count FROM (SELECT DISTINCT id, storage_mode, file_count FROM packages) p LEFT JOIN (SELECT package_id, count(DISTINCT id) AS n FROM package_files WHERE role = 'member' GROUP BY 1) m ON m.package_id = p.id")
def unpack_transition(spark, sf):
    """The packages after those kept whole were unpacked; applied says which were."""
    p = _packages(spark, sf).select("id", "storage_mode", "file_count").distinct()
    m = _files(spark, sf).where(F.col("role") == "member").groupBy("package_id").agg(F.count_distinct("id").alias("n"))
    raw = F.col("storage_mode") == "raw_large"
    both = p.join(m, p["id"] == m["package_id"], "left")
    return both.select("id", M.guarded(raw, F.lit("zip_with_members"), F.col("storage_mode")).alias("storage_mode"), F.coalesce(raw, F.lit(False)).alias("applied"), M.guarded(raw, 1 + F.coalesce("n", F.lit(0)), F.col("file_count").cast("long")).alias("file_count"))


@_query("SELECT line_no, (SELECT max(id) FROM packages) + row_number() OVER (ORDER BY line_no) AS new_id FROM raw_journal")
def assign_ids(spark, sf):
    """Ids for the journal lines, after those of the packages, without gaps."""
    last = F.broadcast(_packages(spark, sf).agg(F.max("id").alias("last")))  # one row
    return O.dense_ids(table(spark, sf, "raw_journal", "line_no").join(last), "line_no", F.col("last")).select("line_no", "new_id")


@_query("SELECT event_id, coalesce(last_value(CASE WHEN value < 5 THEN true WHEN value >= 10 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS blocked FROM events")
def disk_gate_hysteresis(spark, sf):
    """A gate for each user: closed below 5, open again from 10 on, and as it was in between."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "value")
    held = O.carry_signal(e, ["user_id"], "ts", "event_id", O.gate(F.col("value"), 5, 5))
    return held.select("event_id", F.coalesce("held", F.lit(False)).alias("blocked"))


@_query("SELECT event_type AS route, floor(user_id / 100)::BIGINT AS code, count(*) AS n FROM events GROUP BY 1, 2")
def http_metrics(spark, sf):
    e = table(spark, sf, "events", "event_type", "user_id")
    return e.groupBy(F.col("event_type").alias("route"), F.floor(F.col("user_id") / 100).alias("code")).agg(F.count("*").alias("n"))


@_query("""SELECT 'requests_total{route="' || replace(replace(route, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '",code="' || code || '"} ' || n AS line FROM (SELECT event_type AS route, floor(user_id / 100)::BIGINT AS code, count(*) AS n FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2)""")
def metrics_exposition(spark, sf):
    counts = http_metrics(spark, sf).where(F.col("route").isNotNull() & F.col("code").isNotNull())
    return X.exposition(counts, "requests_total", ["route", "code"], F.col("n"))


_BOUNDS = ", ".join(f"({b}::DOUBLE)" for b in X.BOUNDS) + ", ('inf'::DOUBLE)"
_BUCKETS = f"SELECT event_type, le, (SELECT count(*) FROM events x WHERE x.event_type = k.event_type AND x.value <= b.le) AS n FROM (SELECT DISTINCT event_type FROM events WHERE value IS NOT NULL) k, (VALUES {_BOUNDS}) b(le)"


@_query(f"SELECT event_type, CASE WHEN le = 'inf'::DOUBLE THEN '+Inf' ELSE le::VARCHAR END AS le, n FROM ({_BUCKETS})")
def latency_buckets(spark, sf):
    b = X.bucket_counts(table(spark, sf, "events", "event_type", "value"), ["event_type"], "value")
    return b.withColumn("le", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")))


@_query(f"""WITH b AS ({_BUCKETS}), w AS (SELECT *, lag(n, 1, 0) OVER (PARTITION BY event_type ORDER BY le) AS pn, lag(le, 1, 0.0) OVER (PARTITION BY event_type ORDER BY le) AS ple, 0.5 * max(n) OVER (PARTITION BY event_type) AS rank FROM b)
SELECT event_type, round(CASE WHEN le = 'inf'::DOUBLE THEN 10.0 ELSE ple + (le - ple) * (rank - pn) / (n - pn) END, 6) AS quantile FROM w WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1""")
def latency_median(spark, sf):
    q = X.histogram_quantile(table(spark, sf, "events", "event_type", "value"), ["event_type"], "value", 0.5)
    return q.select("event_type", F.round("quantile", 6).alias("quantile"))


@_query(f"""WITH b AS ({_BUCKETS}), w AS (SELECT *, lag(n, 1, 0) OVER (PARTITION BY event_type ORDER BY le) AS pn, lag(le, 1, 0.0) OVER (PARTITION BY event_type ORDER BY le) AS ple, 0.95 * max(n) OVER (PARTITION BY event_type) AS rank FROM b)
SELECT event_type, round(CASE WHEN le = 'inf'::DOUBLE THEN 10.0 ELSE ple + (le - ple) * (rank - pn) / (n - pn) END, 6) AS quantile FROM w WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1""")
def latency_p95(spark, sf):
    q = X.histogram_quantile(table(spark, sf, "events", "event_type", "value"), ["event_type"], "value", 0.95)
    return q.select("event_type", F.round("quantile", 6).alias("quantile"))


@_query("SELECT event_type, epoch_us(date_trunc('minute', ts)) AS start, count(*) AS n, round(count(*) / 60.0, 6) AS rate FROM events GROUP BY 1, 2")
def request_rate(spark, sf):
    r = X.request_rate(table(spark, sf, "events", "event_type", "ts"), ["event_type"], "ts")
    return r.withColumns({"rate": F.round("rate", 6), "start": F.unix_micros("start")})


@_query("""SELECT event_id, '{"k":' || (props->>'k') || ',"link":"/v1/k/' || (props->>'k') || '"}' AS props FROM events WHERE (props->>'k') IS NOT NULL""")
def json_rewrite(spark, sf):
    """Each event's JSON with a link made of one of its fields."""
    e = table(spark, sf, "events", "event_id", "props").select("event_id", F.from_json("props", "k BIGINT").alias("p")).where(F.col("p.k").isNotNull())
    linked = F.col("p").withField("link", F.format_string("/v1/k/%d", F.col("p.k")))
    return e.select("event_id", F.to_json(linked).alias("props"))


@_query("""WITH u AS (SELECT doc_id, author_id, sha256(text) AS h FROM documents WHERE strlen(text) >= 4 AND author_id BETWEEN 1 AND 1000000)
SELECT doc_id, author_id::INT AS supplier_id, h AS package_hash, min(doc_id) OVER (PARTITION BY h) AS canonical_id, doc_id <> min(doc_id) OVER (PARTITION BY h) AS is_clone FROM u""")
def ingest_pipeline(spark, sf):
    """Every document of a valid author taken in as an upload: hashed, and led back to the first with the same bytes."""
    from catalith.streaming.ingest import ingest_batch

    d = table(spark, sf, "documents", "doc_id", "author_id", "text")
    uploads = d.select(F.col("doc_id").alias("id"), F.col("author_id").alias("supplier"), F.col("text").alias("body"))
    return ingest_batch(uploads, None, any_text=True, max_bytes=None).select(F.col("id").alias("doc_id"), "supplier_id", "package_hash", "canonical_id", "is_clone")


_INTAKE = f"""WITH d AS (SELECT doc_id AS id, '<d>' || text || '</d>' AS body FROM documents WHERE author_id BETWEEN 1 AND 1000000 AND text IS NOT NULL),
m AS (SELECT 1000000000 + package_id AS id, (row_number() OVER (PARTITION BY package_id ORDER BY id) - 1)::INT AS sequence_number, name, h FROM (SELECT DISTINCT id, package_id, coalesce(original_filename, 'file_' || id) AS name, coalesce({digits_sql("blob_hash")}, '') AS h FROM package_files WHERE role = 'member' AND package_id IS NOT NULL) WHERE name NOT LIKE '%..%' AND name NOT LIKE '%/'),
f AS (SELECT id AS package_id, 'original' AS role, NULL::VARCHAR AS original_filename, NULL::INT AS sequence_number, sha256(body) AS blob_hash, strlen(body) AS size FROM d
UNION ALL SELECT id, 'member', name, sequence_number, sha256(h), strlen(h) FROM m)"""


def _taken(spark, sf) -> dict[str, DataFrame]:
    """Every document, as XML, and every package's members, as an archive, taken in; those of more than 20 members unpacked later."""
    from catalith.operators.intake import take_in, unpack_late

    d = table(spark, sf, "documents", "doc_id", "author_id", "text", "created_at")
    none = F.lit(None).cast("string").alias("filename")
    plain = d.select(F.col("doc_id").alias("id"), F.col("author_id").cast("string").alias("supplier"), F.col("created_at").alias("received_at"), none, F.encode(F.concat(F.lit("<d>"), "text", F.lit("</d>")), "utf-8").alias("body"))
    zips = _archives(spark, sf).select((F.col("package_id") + 10**9).alias("id"), F.lit("1").alias("supplier"), F.lit(None).cast("timestamp").alias("received_at"), none, "body")
    uploads = cut(plain.unionByName(zips))  # as they would arrive: made once
    taken = take_in(uploads, max_bytes=None, large_entries=20)
    return unpack_late(taken["packages"], taken["package_files"], uploads.select("id", "body"))


def _no_archives(taken: dict[str, DataFrame]) -> DataFrame:
    """The files but the archives themselves, whose bytes SQL does not know."""
    xml = taken["packages"].where(F.col("payload_type") == "xml").select(F.col("id").alias("package_id"))
    files = taken["package_files"]
    return files.where(F.col("role") != "original").unionByName(files.where(F.col("role") == "original").join(xml, "package_id", "left_semi"))


@_query(f"{_INTAKE} SELECT package_id, role, original_filename, sequence_number, blob_hash FROM f")
def ingest_files(spark, sf):
    return _no_archives(_taken(spark, sf)).drop("size")


@_query(f"{_INTAKE} SELECT blob_hash AS content_hash, min(size)::BIGINT AS size, count(*) AS ref_count FROM f GROUP BY 1")
def ingest_blobs(spark, sf):
    from catalith.operators.intake import blob_rows

    taken = _taken(spark, sf)
    return blob_rows(taken["packages"], _no_archives(taken)).select("content_hash", F.col("size").cast("long").alias("size"), "ref_count")


@_query(f"""{_INTAKE}, x AS (SELECT id, min(id) OVER (PARTITION BY body) AS first, 1 AS n FROM d), z AS (SELECT id, count(*) AS n, string_agg(sequence_number || name || h, '|' ORDER BY sequence_number) AS b FROM m GROUP BY id),
w AS (SELECT id, first, n FROM x UNION ALL SELECT id, min(id) OVER (PARTITION BY b), n + 1 FROM z) SELECT id, CASE WHEN first < id THEN first END AS canonical_package_id, n::INT AS file_count FROM w""")
def ingest_packages(spark, sf):
    """The packages taken in: what each repeats, and how many files it has; archives without members left out, which SQL sees none of."""
    return _taken(spark, sf)["packages"].where((F.col("payload_type") == "xml") | (F.col("file_count") > 1)).select("id", "canonical_package_id", "file_count")


_LAST = "j AS (SELECT package_id, max(line_no) AS line_no FROM journal WHERE package_id IS NOT NULL GROUP BY 1)"
_RESTORED = f"{_LAST}, f AS (SELECT f.file_id AS id, j.package_id, {digits_sql('f.blob_hash')} AS h, f.role, f.original_filename, f.sequence_number FROM (SELECT package_id, line_no, unnest(files) AS f FROM journal) x JOIN j USING (package_id, line_no) WHERE f IS NOT NULL)"


def _rebuilt(spark, sf) -> dict[str, DataFrame]:
    from catalith.operators.rebuild import rebuild

    return rebuild(table(spark, sf, "journal"), _index(spark, sf))


@_query(f"""WITH {_RESTORED},
g AS (SELECT h, count(*) AS n FROM (SELECT DISTINCT id, h FROM f) WHERE h IS NOT NULL GROUP BY 1),
e AS (SELECT lower(hex(hash)) AS h, arg_max(logical_size, entry_no) AS size, arg_max(stored_size, entry_no) AS stored_size, arg_max(segment_id, entry_no) AS segment_id FROM segment_index WHERE hash IS NOT NULL GROUP BY 1)
SELECT e.h AS content_hash, e.size, CASE WHEN e.stored_size = 0 THEN e.size ELSE e.stored_size END AS stored_size, e.segment_id, coalesce(g.n, 0) AS ref_count FROM e LEFT JOIN g ON e.h = g.h""")
def rebuild_catalog(spark, sf):
    """The blobs of a catalog made anew from the index and the journal, references counted."""
    return _rebuilt(spark, sf)["content_blobs"]


@_query(f"WITH {_RESTORED} SELECT id, package_id, h AS blob_hash, role, original_filename, sequence_number FROM f")
def rebuild_files(spark, sf):
    return _rebuilt(spark, sf)["package_files"]


@_query(f"""WITH {_LAST} SELECT package_id AS id, supplier_id, epoch_us(try_cast(received_at AS TIMESTAMPTZ)) AS received_at, {digits_sql('package_hash')} AS package_hash, payload_type, storage_mode, original_filename, canonical_package_id, file_count, unpack_error
FROM journal JOIN j USING (package_id, line_no)""")
def rebuild_packages(spark, sf):
    return _rebuilt(spark, sf)["packages"].withColumn("received_at", F.unix_micros("received_at"))


@_query(f"""WITH {_RESTORED}, e AS (SELECT DISTINCT lower(hex(hash)) AS h FROM segment_index WHERE hash IS NOT NULL)
SELECT (SELECT count(*) FROM j) AS n_packages, (SELECT count(*) FROM f) AS n_files, (SELECT count(*) FROM e) AS n_blobs, (SELECT count(DISTINCT h) FROM f WHERE h IS NOT NULL AND h NOT IN (SELECT h FROM e)) AS n_unplaced""")
def rebuild_dry_run(spark, sf):
    """What a rebuild would restore, and how many blobs its files name that no index entry places."""
    t = _rebuilt(spark, sf)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    named = t["package_files"].where(F.col("blob_hash").isNotNull()).select(F.col("blob_hash").alias("content_hash")).distinct()
    lost = named.join(t["content_blobs"], "content_hash", "left_anti")
    parts = [count(t["packages"], "n_packages"), count(t["package_files"], "n_files"), count(t["content_blobs"], "n_blobs"), count(lost, "n_unplaced")]
    one = parts[0]
    for p in parts[1:]:
        one = one.join(F.broadcast(p))  # one row each
    return one


@_query("SELECT min(doc_id) AS doc_id, sha256(text) AS package_hash FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY 2")
def stream_dedup(spark, sf):
    """The first document of each text, by a stream that has read the table to its end."""
    from catalith.streaming.ingest import stream_first_texts

    return stream_first_texts(spark, sf)

"""Queries of the operators for training data: p5 to p10."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.hashes import binary_key, digits_sql, has_digits, hash_key, known_key
from catalith.functions.times import day_number
from catalith.llm.distinct import ALL, BOTH, FIRST, REGISTERS, SECOND, distinct_sketches, estimates, exact_counts, measured, merge_sketches
from catalith.llm.encoding import count_tokens, decode_ids, encode_texts
from catalith.llm.history import history_duplicates, incremental_duplicates
from catalith.llm.membership import fingerprint, key_index, probe_index, seen_before, seen_report
from catalith.llm.mixing import Mix, mix_report
from catalith.llm.spans import SharedSpans
from catalith.session import remove, shared_dir
from catalith.operators.skew import salted_left_join
from catalith.tables import table


def _accepted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The packages with their hashes, the batches, and the members of packages."""
    packages = table(spark, sf, "packages", "id", "package_hash").select("id", hash_key(F.col("package_hash")).alias("key"))
    files = table(spark, sf, "package_files", "package_id", "blob_hash", "role")
    members = files.where((F.col("role") == "member") & has_digits(F.col("blob_hash"))).select("package_id", fingerprint(known_key(F.col("blob_hash"))).alias("item"))
    return packages, table(spark, sf, "intake_batches", "package_id", "batch_no"), members


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return history_duplicates(*_accepted(spark, sf), table(spark, sf, "package_files").count())


def p5_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of p5_found from an index on disk that holds the history and takes the batches in one after the other."""
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    found = incremental_duplicates(*_accepted(spark, sf), path, buckets=64)
    remove(spark, path)  # what each batch repeats is written apart from the index
    return found


def _uploads(spark: SparkSession, sf: str) -> DataFrame:
    """The blobs of all package files with the day and supplier of their package, where it is known."""
    packages = table(spark, sf, "packages", "id", "supplier_id", "received_at").groupBy("id").agg(F.min("supplier_id").alias("supplier_id"), F.min("received_at").alias("received_at"))
    packages = packages.select("id", "supplier_id", day_number(F.col("received_at")).alias("day"))
    files = table(spark, sf, "package_files", "package_id", "blob_hash").where(has_digits(F.col("blob_hash")))
    files = files.select("package_id", fingerprint(known_key(F.col("blob_hash"))).alias("fp"))
    return salted_left_join(files, packages.withColumnRenamed("id", "package_id"), "package_id", table(spark, sf, "package_files").count())


def _named(counts: DataFrame, *more: str) -> DataFrame:
    day = F.when(F.col("level").bitwiseAND(1) == 1, F.date_from_unix_date(F.col("a").cast("int")))
    names = F.create_map(*(F.lit(x) for x in (ALL, "all", FIRST, "day", SECOND, "supplier", BOTH, "day_supplier")))
    return counts.select(names[F.col("level")].alias("level"), day.alias("day"), F.when(F.col("level").bitwiseAND(2) == 2, F.col("b")).alias("supplier_id"), *(more or ("n", "low", "high", "exact")))


def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct content hashes overall, per day, per supplier and per both, with 95 % intervals."""
    return _named(estimates(distinct_sketches(_uploads(spark, sf), F.col("day"), F.col("supplier_id"), F.col("fp"))))


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    what = _uploads(spark, sf), F.col("day"), F.col("supplier_id"), F.col("fp")
    return measured(estimates(distinct_sketches(*what)), exact_counts(*what))


def p6_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The exact count of every group, and whether the estimate is within five standard errors of it."""
    bound = F.when(F.col("exact"), F.lit(0.0)).otherwise(5 / (REGISTERS - 2) ** 0.5 * F.col("n_exact"))
    return _named(_measured(spark, sf).withColumn("within", F.abs(F.col("n") - F.col("n_exact")) <= bound), "n_exact", "within").withColumn("day", F.col("day").cast("string"))


def p6_error(spark: SparkSession, sf: str) -> DataFrame:
    """What the estimates are off by: one row over all groups that are held as registers."""
    off = F.col("n") / F.col("n_exact") - 1
    rmse, inside = F.sqrt(F.avg(off * off)), F.avg(F.col("inside").cast("double"))
    return _measured(spark, sf).where(~F.col("exact")).agg(F.count("*").alias("n_groups"), inside.alias("share_inside"), rmse.alias("relative_rmse"), F.max(F.abs(off)).alias("greatest_error"))


def p6_months(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct content hashes per month, from the sketches of its days."""
    days = distinct_sketches(_uploads(spark, sf), F.col("day"), F.col("supplier_id"), F.col("fp"), (FIRST,))
    month = F.unix_date(F.trunc(F.date_from_unix_date(F.col("a").cast("int")), "month"))
    months = estimates(merge_sketches(days, F.lit(FIRST), month, F.lit(0)))
    return months.select(F.date_from_unix_date(F.col("a").cast("int")).alias("month"), "n", "low", "high", "exact")


def _keys(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    known = table(spark, sf, "content_blobs", "content_hash").where(has_digits(F.col("content_hash"))).select(known_key(F.col("content_hash")).alias("key"))
    return known, table(spark, sf, "segment_index", "entry_no", "hash").select("entry_no", binary_key(F.col("hash")).alias("key"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return seen_before(*_keys(spark, sf), "key", "entry_no").withColumnRenamed("row_no", "entry_no")


def p7_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of p7_found from a stored index of the catalog's keys that takes segment_index in as three batches."""
    known, rows = _keys(spark, sf)
    first, last = table(spark, sf, "segment_index", "entry_no").agg(F.min("entry_no"), F.max("entry_no")).first()
    step = ((last or 0) - (first or 0)) // 3 + 1
    index, found = key_index(known, rows.where(F.lit(False)), "key", "entry_no"), []
    for i in range(3):
        low = (first or 0) + i * step
        seen, index = probe_index(index, rows.where(F.col("entry_no").between(low, low + step - 1)), "key", "entry_no")
        found.append(seen)
    return found[0].unionByName(found[1]).unionByName(found[2]).withColumnRenamed("row_no", "entry_no")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Size of the index, and the expected number and rate of wrong answers."""
    return seen_report(*_keys(spark, sf), "key", "entry_no")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """What the ids of each document stand for, by its digest."""
    back = decode_ids(p8_ids(spark, sf), "ids")
    return back.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens by source and language."""
    counted = count_tokens(table(spark, sf, "documents", "source", "lang", "text"), "text")
    return counted.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "mix_targets", "source", "target_share", "max_repeats")


def _mix(spark: SparkSession, sf: str) -> Mix:
    documents = table(spark, sf, "documents", "doc_id", "text", "source", "lang", "tags")
    lang = F.lower(F.regexp_extract("lang", "^[A-Za-z]+", 0))
    return Mix(documents, _targets(spark, sf), "doc_id", "text", "source", lang, F.try_element_at("tags", F.lit(1)))


def p9_draw(spark: SparkSession, sf: str) -> DataFrame:
    """The documents drawn and how often each is used."""
    return _mix(spark, sf).drawn().select(F.col("doc").alias("doc_id"), "source", "n_tokens", "copies")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of all drawn tokens that each source reaches, and the tokens it could have given at most."""
    mix = _mix(spark, sf)
    report = mix_report(mix.drawn(), _targets(spark, sf)).join(mix.available(), "source", "left")
    return report.withColumn("most_tokens", F.coalesce("most_tokens", F.lit(0)))


def p9_margins(spark: SparkSession, sf: str) -> DataFrame:
    """The share of every source, language and topic: wanted, planned by the weights, and drawn."""
    return _mix(spark, sf).margins()


def p9_limits(spark: SparkSession, sf: str) -> DataFrame:
    """For each source with a target: the documents it has, and whether none was drawn too often or from elsewhere."""
    mix = _mix(spark, sf)
    has = mix.counted.groupBy("source").agg(F.count("*").alias("n_documents"))
    uses = mix.drawn().groupBy("source").agg(F.max("copies").alias("most"), F.count("*").alias("n_rows"), F.count_distinct("doc").alias("n_docs"))
    targets = _targets(spark, sf).where(F.col("source").isNotNull()).groupBy("source").agg(F.min("max_repeats").alias("max_repeats"))
    both = targets.join(has, "source", "left").join(uses, "source", "left")
    kept = F.coalesce((F.col("most") <= F.col("max_repeats")) & (F.col("n_rows") == F.col("n_docs")) & (F.col("n_docs") <= F.col("n_documents")), F.lit(True))
    return both.select("source", "max_repeats", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), kept.alias("within"))


def _spans(spark: SparkSession, sf: str) -> SharedSpans:
    return SharedSpans(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).pairs()


def p10_shared(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each document lies in spans that stand in another one."""
    found = _spans(spark, sf).coverage().withColumnRenamed("doc", "doc_id")
    rest = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
    short = rest.where(F.col("n_chars") < 160).withColumn("n_shared", F.lit(0).cast("long"))
    return found.unionByName(short)


def p10_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The cluster of each document that is long enough, its links, and the one document kept of each cluster."""
    return _spans(spark, sf).clusters().withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (p5_found, p5_incremental, p6_counts, p6_exact, p6_error, p6_months, p7_found, p7_incremental, p7_report, p8_ids, p8_roundtrip, p8_counts, p9_draw, p9_shares, p9_margins, p9_limits, p10_found, p10_shared, p10_clusters)}

_MEMBERS = f"""SELECT DISTINCT f.package_id AS id, {digits_sql('f.blob_hash')} AS h FROM package_files f WHERE f.role = 'member' AND {digits_sql('f.blob_hash')} IS NOT NULL AND f.package_id IN (SELECT id FROM packages)"""

_REPEATS = f"""WITH b AS (SELECT package_id AS id, min(batch_no) AS batch FROM intake_batches GROUP BY 1),
p AS (SELECT p.id, min({digits_sql('p.package_hash')}) AS k, coalesce(min(b.batch), 0) AS batch FROM packages p LEFT JOIN b ON p.id = b.id GROUP BY p.id),
m AS ({_MEMBERS}),
n AS (SELECT id, count(*) AS n FROM m GROUP BY id),
common AS (SELECT x.id, y.id AS other, count(*) AS i FROM m x JOIN p px ON px.id = x.id AND px.batch > 0 JOIN m y ON x.h = y.h AND x.id <> y.id GROUP BY 1, 2),
pairs AS (
  SELECT c.id, c.other FROM common c JOIN n a ON a.id = c.id JOIN n b ON b.id = c.other WHERE 10 * c.i >= 7 * (a.n + b.n - c.i)
  UNION SELECT x.id, y.id FROM p x JOIN p y ON x.k = y.k AND x.id <> y.id WHERE x.batch > 0)
SELECT min(q.other) AS first_id, q.id AS package_id FROM pairs q JOIN p x ON x.id = q.id JOIN p y ON y.id = q.other
WHERE y.batch < x.batch OR (y.batch = x.batch AND y.id < x.id) GROUP BY q.id"""

_SEEN = f"""WITH e AS (SELECT entry_no, lower(hex(hash)) AS h, min(entry_no) OVER (PARTITION BY hash) AS first FROM segment_index WHERE hash IS NOT NULL)
SELECT entry_no FROM e WHERE entry_no > first OR h IN (SELECT {digits_sql('content_hash')} FROM content_blobs WHERE content_hash IS NOT NULL)"""

_LEVELS = (("all", "NULL::VARCHAR", "NULL::BIGINT"), ("day", "day", "NULL::BIGINT"), ("supplier", "NULL::VARCHAR", "supplier_id"), ("day_supplier", "day", "supplier_id"))
_EXACT = f"""WITH p AS (SELECT id, min(supplier_id)::BIGINT AS supplier_id, (min(received_at) AT TIME ZONE 'UTC')::DATE::VARCHAR AS day FROM packages GROUP BY id),
u AS (SELECT DISTINCT f.h, p.day, p.supplier_id FROM (SELECT package_id, {digits_sql('blob_hash')} AS h FROM package_files) f LEFT JOIN p ON f.package_id = p.id WHERE f.h IS NOT NULL)
""" + " UNION ALL ".join(f"SELECT '{name}' AS level, {day} AS day, {supplier} AS supplier_id, count(DISTINCT h) AS n_exact, true AS within FROM u GROUP BY 1, 2, 3" for name, day, supplier in _LEVELS)

# every stretch of 160 code points, wherever it begins
_STRETCHES = """WITH RECURSIVE g AS MATERIALIZED (SELECT doc_id, i, substr(text, i, 160) AS s, md5(text) AS t FROM (SELECT doc_id, text, unnest(range(1, length(text) - 158)) AS i FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 160)),
once AS (SELECT DISTINCT doc_id, s FROM g), common AS (SELECT s FROM once GROUP BY s HAVING count(*) > 1),
pairs AS (SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM once a JOIN common USING (s) JOIN once b ON a.s = b.s AND a.doc_id < b.doc_id)"""
_SHARED = f"""{_STRETCHES}, p AS (SELECT doc_id, least(160, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 160)) AS n FROM g JOIN common USING (s)),
c AS (SELECT doc_id, sum(n)::BIGINT AS n FROM p GROUP BY 1) SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(c.n, 0) AS n_shared FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id"""
_CLUSTERS = f"""{_STRETCHES}, linked AS (SELECT doc_a AS a, doc_b AS b FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
reach AS (SELECT DISTINCT doc_id AS doc, doc_id AS far FROM g UNION SELECT reach.doc, linked.b FROM reach JOIN linked ON linked.a = reach.far),
n AS (SELECT s, count(DISTINCT t) - 1 AS n FROM g GROUP BY s), m AS (SELECT doc_id, max(n) AS n FROM g JOIN n USING (s) GROUP BY 1)
SELECT doc AS doc_id, min(far) AS cluster, min(m.n) AS n_links, min(far) = doc AS kept FROM reach JOIN m ON m.doc_id = doc GROUP BY doc"""

SQL = {
    "p5_found": _REPEATS,
    "p5_incremental": _REPEATS,
    "p6_exact": _EXACT,
    "p7_found": _SEEN,
    "p7_incremental": _SEEN,
    "p8_roundtrip": "SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, sha256(coalesce(text, '')) AS digest FROM documents",
    "p10_found": f"{_STRETCHES} SELECT doc_a, doc_b FROM pairs",
    "p10_shared": _SHARED,
    "p10_clusters": _CLUSTERS,
    "p9_limits": """SELECT t.source, min(t.max_repeats) AS max_repeats, coalesce(min(d.n), 0) AS n_documents, true AS within FROM mix_targets t
LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE length(text) > 0 AND doc_id IS NOT NULL GROUP BY 1) d ON d.source = t.source WHERE t.source IS NOT NULL GROUP BY t.source""",
}

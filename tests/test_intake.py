import datetime as dt
import hashlib

from catalith.operators.intake import blob_rows, take_in, unpack_late
from tests_support import archive

UPLOADS = "id long, supplier string, received_at timestamp, filename string, body binary, size int"
sha = lambda b: hashlib.sha256(b).hexdigest()


def uploads(spark, *bodies, first=1):
    day = dt.datetime(2025, 1, 1)
    rows = [(first + i, "2447", day + dt.timedelta(hours=first + i), f"f{i}", b, 0) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, UPLOADS)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_many_copies_are_one_blob(spark):
    got = take_in(uploads(spark, *[b"<a/>"] * 100))
    blobs = blob_rows(got["packages"], got["package_files"]).collect()
    assert got["packages"].count() == 100 and [(b["content_hash"], b["ref_count"], b["size"]) for b in blobs] == [(sha(b"<a/>"), 100, 4)]
    assert blobs[0]["first_seen_at"] == dt.datetime(2025, 1, 1, 1)


def test_members_are_deduplicated_across_archives(spark):
    one, two = archive(("a.xml", b"<shared/>"), ("b.xml", b"<other/>"), ("../x", b"no"), ("d/", b"")), archive(("c.xml", b"<shared/>"))
    got = take_in(uploads(spark, one, two, one))
    assert blob_rows(got["packages"], got["package_files"]).count() == 4
    assert rows(got["packages"], "id", "canonical_package_id", "storage_mode", "file_count") == [(1, None, "zip_with_members", 3), (2, None, "zip_with_members", 2), (3, 1, "zip_with_members", 3)]
    members = [("member", "a.xml", 0, sha(b"<shared/>")), ("member", "b.xml", 1, sha(b"<other/>"))]
    for p in (1, 3):
        assert rows(got["package_files"].where(f"package_id = {p}"), "role", "original_filename", "sequence_number", "blob_hash") == [*members, ("original", "f0", None, sha(one))]


def test_a_damaged_archive_and_refused_uploads(spark):
    bad = bytes.fromhex("504b0304000000")
    got = take_in(uploads(spark, bad, b"", None, b"plain text", b"<a>" + b"x" * 90 + b"</a>"), max_bytes=50)
    (package,) = got["packages"].collect()
    error = package["unpack_error"]
    assert (package["id"], package["file_count"]) == (1, 2) and error
    assert rows(got["package_files"], "role", "original_filename", "blob_hash") == [("original", "f0", sha(bad)), ("unpack_error", "_unpack_error.txt", sha(error.encode()))]
    assert rows(got["rejected"], "id", "reason") == [(2, "empty"), (3, "empty"), (4, "unsupported"), (5, "too_large")]


def test_large_archives_are_unpacked_later_and_their_clones_with_them(spark):
    big, small = archive(*((f"{i}.xml", b"<x/>" * i) for i in range(1, 5))), archive(("a.xml", b"<x/>"))
    up = uploads(spark, big, big, small)
    got = take_in(up, large_entries=2)
    assert rows(got["packages"], "id", "storage_mode", "file_count") == [(1, "raw_large", 1), (2, "raw_large", 1), (3, "zip_with_members", 2)]
    late = unpack_late(got["packages"], got["package_files"], up.select("id", "body"))
    assert rows(late["packages"], "id", "storage_mode", "file_count") == [(1, "zip_with_members", 5), (2, "zip_with_members", 5), (3, "zip_with_members", 2)]
    assert late["package_files"].groupBy("package_id").count().where("count = 5").count() == 2
    again = unpack_late(late["packages"], late["package_files"], up.select("id", "body"))
    assert rows(again["packages"], *again["packages"].columns) == rows(late["packages"], *late["packages"].columns) and again["package_files"].count() == late["package_files"].count()
    by_size = take_in(up, large_bytes=len(small))
    assert rows(by_size["packages"], "id", "storage_mode") == [(1, "raw_large"), (2, "raw_large"), (3, "zip_with_members")]


def test_a_later_batch_repeats_stored_packages(spark):
    zip_ = archive(("a.xml", b"<x/>"))
    old = take_in(uploads(spark, b"<a/>", zip_, b"<a/>"))
    new = take_in(uploads(spark, b"<a/>", zip_, b"<new/>", first=10), old["packages"], old["package_files"])
    assert rows(new["packages"], "id", "canonical_package_id", "file_count") == [(10, 1, 1), (11, 2, 2), (12, None, 1)]
    assert rows(new["package_files"], "package_id", "role", "original_filename") == [(10, "original", "f0"), (11, "member", "a.xml"), (11, "original", "f1"), (12, "original", "f2")]


def test_nothing(spark):
    got = take_in(uploads(spark).limit(0))
    assert all(t.count() == 0 for t in got.values()) and blob_rows(got["packages"], got["package_files"]).count() == 0

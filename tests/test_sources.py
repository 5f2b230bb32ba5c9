import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.sources import records as R
from catalith.sources import segments as G
from catalith.sources.compression import compress, decompress, load_dictionary, save_dictionary, train_dictionary
from catalith.sources.journal import parse_lines, read_journal, write_journal
from tests_support import archive

XML, ZIP = R.MAGIC["XML1"], R.MAGIC["ZIP1"]


def test_crc32c_of_known_text():
    assert R.crc32c(b"123456789") == 0xE3069283 and R.crc32c(b"") == 0


def test_crc32c_of_many():
    def slow(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    rnd = random.Random(4)
    data = [rnd.randbytes(n) for n in (0, 1, 7, 8, 9, 511, 512, 513, 1024, 3000, 5)] + [b"\0" * 700]
    assert R.crc32c_many(data).tolist() == list(map(slow, data)) and len(R.crc32c_many([])) == 0


def test_contents_stored_and_read_by_their_index(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i % 2, i, XML, None if i == 5 else rnd.randbytes(rnd.choice([0, 5, 800, 3000])), rnd.randbytes(32), 7, None) for i in range(60)]
    df = spark.createDataFrame(rows, "shard_id int, order long, magic long, payload binary, hash binary, supplier_id long, dict_id long")
    index = G.store_contents(df, str(tmp_path), 8000).collect()
    assert len(index) == 60 and len({(r["shard_id"], r["segment_id"]) for r in index}) > 6
    files = {(s, int(f.stem[-4:])): f for s in (0, 1) for f in (tmp_path / f"shard_{s:04d}").glob("*.dat")}
    assert all(f.stat().st_size <= 8000 for f in files.values()) and len(files) == len({(r["shard_id"], r["segment_id"]) for r in index})
    by_file = {r["segment_id"]: r for r in G.read_indexes(spark, str(tmp_path / "shard_0001")).where("segment_id = 1").collect()}
    assert by_file and all(r["supplier_id"] == 7 for r in by_file.values())
    places = spark.createDataFrame([(r["shard_id"], r["segment_id"], r["offset"], r["stored_size"]) for r in index], "shard_id int, segment_id int, offset long, stored_size long")
    got = {(r["shard_id"], r["segment_id"], r["offset"]): r for r in G.read_places(places.unionByName(places), str(tmp_path), 1000).collect()}
    want = {bytes(h): p or b"" for *_, p, h, _, _ in rows}
    assert len(got) == 60 and all(got[r["shard_id"], r["segment_id"], r["offset"]]["payload"] == want[bytes(r["hash"])] and got[r["shard_id"], r["segment_id"], r["offset"]]["crc_ok"] for r in index)
    wrong = spark.createDataFrame([(0, 0, 1, 50), (0, 0, 10**9, 50)], "shard_id int, segment_id int, offset long, stored_size long")
    assert not any(r["crc_ok"] for r in G.read_places(wrong, str(tmp_path)).collect())
    assert G.store_contents(df.limit(0), str(tmp_path / "none")).count() == 0


def test_scan_goes_on_behind_footers_and_empty_records():
    parts = [R.encode_record(XML, b"one"), R.encode_footer(1, 15), R.encode_record(ZIP, b""), R.encode_record(XML, b"three")]
    rows = list(R.scan_segment(b"".join(parts)))
    assert [(m, p, ok) for _, m, p, ok in rows] == [(XML, b"one", True), (ZIP, b"", True), (XML, b"three", True)]
    assert R.read_footer(parts[0] + parts[1]) == (1, 15) and R.read_footer(b"x" * 40) is None
    damaged = bytearray(parts[0] + parts[3])
    damaged[9] ^= 1
    assert [ok for *_, ok in R.scan_segment(bytes(damaged))] == [False, True]
    assert len(list(R.scan_segment(b"".join(parts)[:-1]))) == 2 and list(R.scan_segment(b"junk" * 10)) == []


def test_index_round_trip_and_damage():
    rows = np.zeros(2, R.INDEX_ROW)
    rows["offset"], rows["supplier_id"], rows["hash"] = [128, 400], 1577, np.void(bytes(range(32)))
    data = R.encode_index(rows)
    assert len(data) == 2 * 60 + 32 and (R.decode_index(data) == rows).all()
    for bad in (data[:-1], b"", bytes([data[0] ^ 1]) + data[1:], data[60:]):
        with pytest.raises(ValueError):
            R.decode_index(bad)
    assert zlib.crc32(data[:120]) and len(R.decode_index(R.encode_index(rows[:0]))) == 0


def test_segments_written_and_read(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(s, i * 100, XML, rnd.randbytes(rnd.choice([0, 5, 5000]))) for s in (0, 3) for i in range(20)]
    df = spark.createDataFrame(rows, "segment_id int, offset long, magic long, payload binary")
    written = {r["segment_id"]: r["n_records"] for r in G.write_segments(df, str(tmp_path)).collect()}
    assert written == {0: 20, 3: 20}
    back = G.read_segments(spark, str(tmp_path))
    assert sorted((r["segment_id"], bytes(r["payload"])) for r in back.collect()) == sorted((s, p) for s, _, _, p in rows)
    place = spark.createDataFrame([(3, 0)], "segment_id int, offset long")
    assert G.read_point(back, place).count() == 1
    with open(tmp_path / "segment_0001.idx", "wb") as file:
        file.write(R.encode_index(np.zeros(3, R.INDEX_ROW)))
    assert [r["segment_id"] for r in G.read_indexes(spark, str(tmp_path)).collect()] == [1, 1, 1]


def test_archives(spark):
    bodies = [archive(("a.xml", b"<a/>"), ("dir/", b""), ("../x", b"no"), ("b", b"")), b"PK\x03\x04\0\0\0", None, archive()]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body binary")
    rows = G.archive_members(df, "id", "body").collect()
    assert [(r["sequence_number"], r["filename"], bytes(r["data"])) for r in rows if r["id"] == 0] == [(0, "a.xml", b"<a/>"), (1, "b", b"")]
    assert sorted(r["id"] for r in rows if r["error"]) == [1, 2] and not [r for r in rows if r["id"] == 3]
    assert {r["id"]: r["n_entries"] for r in G.entry_count(df, "body").collect()} == {0: 3, 1: None, 2: None, 3: 0}


def test_compression_round_trip(spark, tmp_path):
    xml = [f"<notice number='{i}'><supplier>{i % 7}</supplier><text>the same words in every notice</text></notice>".encode() for i in range(200)]
    rows = [(i, x) for i, x in enumerate([*xml, b"short", random.Random(1).randbytes(500), b"", None])]
    df = spark.createDataFrame(rows, "i int, payload binary")
    dictionary = train_dictionary(df, "payload", "i", 4096)
    for d in (None, dictionary):
        packed = compress(df, "payload", d)
        flags = {r["i"]: r["is_compressed"] for r in packed.collect()}
        assert flags[0] and not any(flags[i] for i in (200, 201, 202, 203))
        back = decompress(packed.drop("payload"), "stored", d)
        assert {r["i"]: None if r["payload"] is None else bytes(r["payload"]) for r in back.collect()} == dict(rows)
    assert train_dictionary(df.limit(1), "payload", "i") is None
    save_dictionary(str(tmp_path), 3, dictionary)
    assert load_dictionary(str(tmp_path)) == (3, dictionary) and load_dictionary(str(tmp_path / "none")) is None
    next(tmp_path.glob("*.zdict")).write_bytes(b"damaged")
    with pytest.raises(ValueError):
        load_dictionary(str(tmp_path))


def test_journal_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1001, 1577, None, "AB" * 32, None, 1)], "id long, supplier_id int, received_at timestamp, package_hash string, original_filename string, file_count int")
    p = p.withColumns({"payload_type": F.lit("xml"), "storage_mode": F.lit("single"), "canonical_package_id": F.lit(None).cast("long"), "unpack_error": F.lit(None).cast("string")})
    f = spark.createDataFrame([(2001, 1001, " " + "AB" * 32, "original", None, None)], "id long, package_id long, blob_hash string, role string, original_filename string, sequence_number int")
    path = str(tmp_path / "journal")
    assert read_journal(spark, path).count() == 0
    write_journal(p, f, path)
    (row,) = read_journal(spark, path).collect()
    assert (row["package_id"], row["received_at"], row["files"][0]["file_id"], row["files"][0]["blob_hash"]) == (1001, None, 2001, "ab" * 32)
    with pytest.raises(Exception):
        parse_lines(spark.createDataFrame([("{damaged",)], "line string")).collect()


def test_a_replica_fetches_what_it_lacks(spark, tmp_path):
    from catalith.sources.folders import sync_folder

    a, b = tmp_path / "a", tmp_path / "b"
    (a / "x").mkdir(parents=True), b.mkdir()
    for name, data in (("1.dat", b"one"), ("x/2.dat", b"two"), ("3.dat", b"same"), ("4.dat", b"")):
        (a / name).write_bytes(data)
    (b / "1.dat").write_bytes(b"eno"), (b / "3.dat").write_bytes(b"same"), (b / "own").write_bytes(b"stays")
    assert {r["name"] for r in sync_folder(spark, str(a), str(b)).collect()} == {"1.dat", "x/2.dat", "4.dat"}
    assert {str(p.relative_to(b)): p.read_bytes() for p in b.rglob("*") if p.is_file() and not p.name.startswith(".")} == {"1.dat": b"one", "x/2.dat": b"two", "3.dat": b"same", "4.dat": b"", "own": b"stays"}
    assert sync_folder(spark, str(a), str(b)).count() == 0

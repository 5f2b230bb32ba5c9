import json
import time

from catalith.operators.nested import JOURNAL, ROOT, files_of_entries, layout, number, parse, schema_graph, shred, table_of, _BAD


def found(spark, *lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, line string")
    return sorted(map(tuple, files_of_entries(shred(df, "line_no", "line", JOURNAL, with_fields=False)).collect()), key=repr)


def test_entries_of_any_depth(spark):
    entry = lambda p, *f: {"package_id": p, "files": [{"file_id": x} for x in f]}
    lines = [
        json.dumps(entry(1, 10, 11)),
        json.dumps({"shard": {"shard_id": 3}, "entries": [entry(2, 20), entry("3"), {"package_id": 4}]}),
        json.dumps({"v": 2, "bundles": [{"entries": entry(5, 50)}, {"entries": [[entry(6.0, 60, 60)]]}]}),
        json.dumps([{"package_id": 7, "files": {"file_id": "70"}}, None, 5]),
        json.dumps({"package_id": 8, "files": [None, {"file_id": 80, "attrs": {"notes": [{"package_id": 9, "files": []}]}}]}),
    ]
    assert found(spark, *lines) == sorted([(0, 1, 10), (0, 1, 11), (1, 2, 20), (1, 3, 0), (1, 4, 0), (2, 5, 50), (2, 6, 60), (3, 7, 70), (4, 8, 80), (4, 9, 0)], key=repr)


def test_lines_that_are_no_json(spark):
    good = '{"package_id": 1}'
    assert found(spark, None, "", "  ", good[:-1], good + good, good + ",", '{"package_id": NaN}', '{"package_id" 1}', f" \t{good} ") == [(8, 1, 0)]


def test_without_lines(spark):
    assert found(spark) == [] and found(spark, "5", "[]", "null") == []


def test_null_id_is_no_entry_and_file_without_id(spark):
    assert found(spark, '{"package_id": null, "files": [{"file_id": 1}]}', '{"package_id": 2, "files": [{}]}') == [(1, 2, None)]


def test_deep_and_long_values():
    deep = '{"a":' * 50_000 + "1" + "}" * 50_000
    assert parse(deep) is not _BAD and parse(deep + "}") is _BAD
    assert len(parse('"' + "x" * 1_000_000 + '"')) == 1_000_000


def test_numbers():
    assert [number(x) for x in (5, "5", " 5 ", "5.0", 5.0, "5e0", True, None, "x", 5.5, 2**63, "", [1], "NaN")] == [5, 5, 5, 5, 5, 5] + [None] * 8
    assert [number(x) for x in ("1_000", "٣", "0x5", "5.", ".5", "-0.0", "1e-400000")] == [None, None, None, 5, None, 0, None]


def test_numbers_are_exact_and_any_exponent_is_cheap():
    began = time.time()
    ids = [parse(f'{{"package_id": {x}}}')["package_id"] for x in ("9007199254740993.0", "90071992547409930e-1", "1e999999999", "1e99999999999999999999999", "-1e400000", "1" + "0" * 100_000, "0." + "9" * 100_000, "0e999999999")]
    assert [number(x) for x in ids] == [9007199254740993] * 2 + [None] * 5 + [0]
    assert [number(x) for x in ("9007199254740993.0", "1e999999999")] == [9007199254740993, None] and time.time() - began < 1


def test_files_of_an_object_inside_are_not_the_entrys(spark):
    lines = ['{"package_id": 1, "meta": {"files": [{"file_id": 5}]}}', '{"package_id": 2, "files": [{"file_id": 6, "package_id": 7}]}']
    assert found(spark, *lines) == [(0, 1, 0), (1, 2, 6), (1, 7, 0)]


def test_layout_inlines_singletons_only():
    edges = {(ROOT, "head", "head", False), ("head", "shard", "shard", False), ("entry", "shard", "shard", False), (ROOT, "entries", "entry", True), ("entry", "attrs", "attrs", False), ("attrs", "note", "note", True), ("note", "reply", "note", False)}
    assert layout(edges, set()).tables == {ROOT, "shard", "entry", "note"}


def test_tables_and_their_keys(spark):
    line = {"shard": {"id": "s"}, "entries": [{"package_id": 1, "x": None, "attrs": {"size": 5, "ok": True}, "files": [{"file_id": 2, "blob_hash": "ab"}]}]}
    df = spark.createDataFrame([(7, json.dumps(line), 1, "f")], "line_no long, line string, node int, element string")
    rows = shred(df, "line_no", "line", JOURNAL)
    plan = schema_graph(df, "line_no", "line", JOURNAL)
    assert plan.tables == {ROOT, "entry", "file"}
    (root,) = table_of(rows, ROOT, ["shard.id"]).collect()
    (entry,) = table_of(rows, "entry", ["attrs.size", "attrs.ok", "x"]).collect()
    (file,) = table_of(rows, "file", ["blob_hash"]).collect()
    assert (entry["via"], file["via"]) == ("entries", "files")
    assert root["shard.id"] == "s" and (entry["attrs.size"], entry["attrs.ok"], entry["x"]) == ("5", "true", None)
    assert (entry["parent"], entry["parent_node"]) == (ROOT, root["node"]) and (file["parent_node"], file["owner_id"], file["id"]) == (entry["node"], 1, 2)

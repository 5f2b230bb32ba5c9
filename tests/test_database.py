import pytest

from catalith.engine import Engine
from catalith.operators.intake import take_in
from catalith.operators.loadgen import made_uploads
from catalith.sources.database import append_table, create_catalog, read_table, run_statements


def test_rows_go_to_a_database_and_back(spark):
    url = "jdbc:derby:memory:catalith;create=true"
    rows = [(i if i % 7 else None, f"n{i}") for i in range(40)]
    append_table(spark.createDataFrame(rows, "id long, name string"), url, "things")
    append_table(spark.createDataFrame([(99, "late")], "id long, name string"), url, "things")
    key = lambda r: (r[0] is None, r)
    whole, parts = read_table(spark, url, "things"), read_table(spark, url, "things", "ID", 4)
    assert parts.rdd.getNumPartitions() == 4
    for df in (whole, parts):
        assert sorted((tuple(r) for r in df.collect()), key=lambda r: r[1]) == sorted([*rows, (99, "late")], key=lambda r: r[1])
    assert read_table(spark, url, "(SELECT * FROM things WHERE 1 = 0) t", "ID").count() == 0


def test_statements_run_in_order_up_to_an_error(spark, tmp_path):
    (tmp_path / "2.sql").write_text("CREATE OR REPLACE TEMP VIEW b AS\nSELECT n + 1 AS n FROM a;\n")
    (tmp_path / "1.sql").write_text("-- the first;\nCREATE OR REPLACE TEMP VIEW a AS SELECT 1 AS n;\nCREATE OR REPLACE TEMP VIEW c AS SELECT ';' AS s")
    (tmp_path / "no.txt").write_text("nonsense")
    assert run_statements(spark, str(tmp_path)) == ["1.sql", "2.sql"] and spark.table("b").first()[0] == 2 and spark.table("c").first()[0] == ";"
    (tmp_path / "3.sql").write_text("nonsense;\n")
    with pytest.raises(Exception):
        run_statements(spark, str(tmp_path))


def test_an_empty_catalog(spark, tmp_path):
    create_catalog(spark, str(tmp_path))
    create_catalog(spark, str(tmp_path))
    engine = Engine(spark, str(tmp_path))
    assert engine.manifests().count() == 0 and engine.supplier_stats().count() == 0


def test_made_uploads_repeat_as_often_as_asked(spark):
    up = made_uploads(spark, 4000, 0.3)
    taken = take_in(up)["packages"]
    clones = taken.where("canonical_package_id IS NOT NULL").count()
    assert taken.count() == 4000 and 0.25 * 3500 < clones < 0.35 * 3500
    assert up.exceptAll(made_uploads(spark, 4000, 0.3).repartition(7)).count() == 0

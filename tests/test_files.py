import sqlite3

import pytest
from pyspark.errors import PythonException

from tessera.sources import files, sinks
from tessera.streaming import telemetry


def test_spreadsheets_read_back(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    df = spark.createDataFrame([("é & <x>", 1), (" b ", None)], "name string, n int")
    assert files.append_xlsx(df, path) == 2
    assert files.append_xlsx(spark.createDataFrame([("c", "z")], "name string, more string"), path) == 3
    rows = sorted((r.row_number, dict(r.fields)) for r in files.xlsx(spark, path).collect())
    assert rows == [(2, {"name": "é & <x>", "n": "1", "more": ""}), (3, {"name": " b ", "n": "", "more": ""}), (4, {"name": "c", "n": "", "more": "z"})]


def test_sheet_with_shared_strings_and_gaps():
    import io
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="4"><c r="C4"><v>7</v></c></row></sheetData></worksheet>')
    assert list(files.sheet_rows(out.getvalue())) == [(1, ["name", "", "two runs"]), (4, ["", "", "7"])]


def test_sqlite_versions_and_columns(spark, tmp_path):
    path = str(tmp_path / "r.sqlite3")
    base = sqlite3.connect(path)
    base.execute("PRAGMA user_version = 5")
    base.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    base.execute("INSERT INTO t VALUES (1, NULL), (2, 'x')")
    base.commit()
    base.close()
    assert sorted(tuple(r) for r in files.sqlite_table(spark, path, "t", ["a", "b", "c"]).collect()) == [("1", None, None), ("2", "x", None)]
    assert files.sqlite_table(spark, path, "t", ["a", "b"], versions=(5,)).count() == 2
    with pytest.raises(PythonException):
        files.sqlite_table(spark, path, "t", ["a", "b"], versions=(6,)).count()
    assert sinks.snapshot(spark, path, str(tmp_path / "copy.sqlite3")) is True


def test_configuration(spark, tmp_path):
    path = tmp_path / "c.json"
    assert files.configuration(spark, str(path), {"a": 1}, {"a": None}) == {"a": 1}
    path.write_text('{"a": 2}')
    assert files.configuration(spark, str(path), {"a": 1, "b": 0}, {"b": 3}) == {"a": 2, "b": 3}
    path.write_text('{"z": 2}')
    with pytest.raises(ValueError):
        files.configuration(spark, str(path), {"a": 1}, {})


def test_pointer_needs_its_export(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.point_latest(spark, str(tmp_path), "none")


def test_merged_table_has_each_key_once(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.range(50).selectExpr("id % 20 as k", "id as v")
    assert telemetry.append_new(df, path, ["k"], parts=4) == 20 and telemetry.append_new(df, path, ["k"], parts=4) == 0
    assert telemetry.append_new(spark.range(18, 23).selectExpr("id as k", "id as v"), path, ["k"], parts=4) == 3
    assert telemetry.merged(spark, path).count() == 23 and telemetry.merged(spark, path).columns == ["k", "v"]


def test_a_manifest_falls_before_its_data(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.publish(spark.range(3), path)
    with pytest.raises(Exception, match="boom"):
        sinks.publish(spark.range(3).selectExpr("raise_error('boom') as id"), path)
    assert not files._exists(spark, f"{path}/manifest")

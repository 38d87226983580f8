"""Workbooks written and read: all sheets, awkward cells, sizes, and the committing writer."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgermill.sources import workbook

ROWS = [(n, f"имя & <{n}> \"q\" 'a'  ", None if n % 3 == 0 else n * 1.5, n % 2 == 0) for n in range(1, 24)]
SCHEMA = "`Код` long, `Наименование` string, `Цена` double, `Да` boolean"


def test_round_trip_in_several_books(spark):
    books = workbook.made_workbooks(spark.createDataFrame(ROWS, SCHEMA), "Код", 10, "Л & 1")
    rows = workbook.workbook_rows(books).collect()
    assert {r["file"] for r in rows} == {f"export-{n:05d}.xlsx" for n in (1, 2, 3)} and {r["sheet"] for r in rows} == {"Л & 1"}
    got = {int(r["cells"][0]): (r["file"], r["row"], r["cells"]) for r in rows if r["row"] > 1}
    for n, name, price, yes in ROWS:
        file, row, cells = got[n]
        assert (file, row) == (f"export-{(n - 1) // 10 + 1:05d}.xlsx", (n - 1) % 10 + 2)
        assert cells[1] == name and cells[3] == str(yes) and (cells[2] is None if price is None else float(cells[2]) == price)


def test_columns_and_characters(spark):
    assert [workbook._letters(i) for i in (0, 25, 26, 27, 701, 702)] == ["A", "Z", "AA", "AB", "ZZ", "AAA"]
    content = workbook.workbook_bytes("S", ["h"], [["a\x00b\x0bc"], [None], [float("1e300")], [-5]])
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        assert book.testzip() is None
    assert [(row, cells) for _, _, row, cells in workbook.sheet_rows(content)] == [(1, ["h"]), (2, ["abc"]), (4, ["1e+300"]), (5, ["-5"])]


def test_sheets_are_tasks_of_their_own(spark):
    from tests.matching.test_operators import book

    one = book([["a", "b"], ["1", "2"]])
    with zipfile.ZipFile(io.BytesIO(one)) as z:
        files = {n: z.read(n) for n in z.namelist()}
    files["xl/workbook.xml"] = b'<workbook xmlns:r="r"><sheets><sheet name="S" r:id="i1"/><sheet name="T" r:id="i2"/></sheets></workbook>'
    files["xl/_rels/workbook.xml.rels"] = b'<Relationships><Relationship Id="i1" Target="worksheets/s.xml"/><Relationship Id="i2" Target="/xl/worksheets/t.xml"/></Relationships>'
    files["xl/worksheets/t.xml"] = b'<worksheet><sheetData><row r="3"><c r="B3" t="s"><v>0</v></c></row></sheetData></worksheet>'
    files["xl/sharedStrings.xml"] = b"<sst><si><t>shared</t></si></sst>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    books = spark.createDataFrame([("x.xlsx", out.getvalue())], "path string, content binary")
    rows = sorted((r["sheet"], r["sheet_no"], r["row"], r["cells"]) for r in workbook.workbook_rows(books).collect())
    assert rows == [("S", 0, 1, ["a", "b"]), ("S", 0, 2, ["1", "2"]), ("T", 1, 3, [None, "shared"])]


def test_committing_writer(spark, tmp_path):
    spark.dataSource.register(workbook.WorkbookSource)
    rows = spark.createDataFrame(ROWS, SCHEMA)
    books = workbook.made_workbooks(rows, "Код", 10)
    books.write.format("workbook").mode("append").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"export-{n:05d}.xlsx" for n in (1, 2, 3)]
    again = workbook.read_sheets(spark, str(tmp_path))
    assert again.count() == len(ROWS) + 3
    broken = books.withColumn("content", F.when(F.col("path").contains("2"), F.raise_error(F.lit("no"))).otherwise(F.col("content")).cast("binary")).withColumn("path", F.concat(F.lit("new-"), "path"))
    with pytest.raises(Exception):
        broken.write.format("workbook").mode("append").save(str(tmp_path))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("new-")]


def test_too_large(spark, tmp_path, monkeypatch):
    (tmp_path / "a.xlsx").write_bytes(workbook.workbook_bytes("S", ["h"], [["v"]]))
    monkeypatch.setattr(workbook, "MOST_BYTES", 10)
    with pytest.raises(Exception, match="too large"):
        workbook.read_sheets(spark, str(tmp_path)).collect()

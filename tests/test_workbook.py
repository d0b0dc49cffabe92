"""Workbooks read, made, and changed in place; formulas moved; entries put in their rows."""

from __future__ import annotations

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quiresmith.functions.formulas import column_name, column_number, shift, shifted
from quiresmith.plans import workbook
from quiresmith.sources import readers, sinks, xlsx

MAIN = xlsx.MAIN


@pytest.mark.parametrize(
    ("formula", "rows", "columns", "out"),
    [
        ("A1+B$2*$C3", 1, 1, "B2+C$2*$C4"),
        ('SUM(A1:A9)&"A1 ""B2"""', 2, 0, 'SUM(A3:A11)&"A1 ""B2"""'),
        ("'My A1'!B2+Sheet2!C3", 1, 0, "'My A1'!B3+Sheet2!C4"),
        ("LOG10(A1)+ABC_1+A1B", 3, 0, "LOG10(A4)+ABC_1+A1B"),
        ("A:C+$B:D+2:3+$4:5", 1, 1, "B:D+$B:E+3:4+$4:6"),
        ("A1", -1, 0, "#REF!"),
        ("B2:A1", 0, -1, "A2:#REF!"),
        ("Table1[[#This Row],[A1]]+a1", 1, 0, "Table1[[#This Row],[A1]]+A2"),
        ("XFD1048576", 0, 0, "XFD1048576"),
        ("XFE1+ZZZ9", 1, 1, "XFE1+ZZZ9"),
        ("IF(J2>0,TRUE,1.5E3)", 5, 0, "IF(J7>0,TRUE,1.5E3)"),
        ("", 1, 1, ""),
    ],
)
def test_shift(formula, rows, columns, out):
    assert shift(formula, rows, columns) == out


def test_columns(spark):
    assert [column_name(n) for n in (1, 26, 27, 702, 703, 16384)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert all(column_number(column_name(n)) == n for n in range(1, 2000))
    df = spark.createDataFrame([("A1", 1), (None, 2)], "f string, n int")
    assert [r[0] for r in df.select(shifted("f", "n", F.lit(1))).collect()] == ["B2", None]


SHEET = f"""<?xml version="1.0"?><worksheet xmlns="{MAIN}" xmlns:r="{xlsx.LINKS}"><dimension ref="A1:K4"/><sheetViews><sheetView workbookViewId="0"/></sheetViews><sheetData>
<row r="1" spans="1:11"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>Marks</t></is></c><c r="D1" t="str"><f>"MS "&amp;"filename"</f><v>MS filename</v></c><c r="J1" t="s"><v>2</v></c></row>
<row r="2"><c r="A2" s="3" t="inlineStr"><is><t>physics</t></is></c><c r="B2" s="4" t="inlineStr"><is><r><t>a_q1</t></r><r><t>_Q.png</t></r><rPh sb="0" eb="1"><t>x</t></rPh></is></c><c r="C2"><v>7</v></c><c r="J2" s="5"><f t="shared" ref="J2:J4" si="0">B2&amp;$A$1</f><v>0</v></c><c r="K2" t="b"><v>1</v></c></row>
<row r="3" ht="20"><c r="A3" s="3"/><c r="J3"><f t="shared" si="0"/><v>0</v></c></row><row r="4"><c r="J4"><f t="shared" si="0"/></c></row></sheetData><tableParts count="1"><tablePart r:id="rId1"/></tableParts></worksheet>"""
PARTS = {
    "[Content_Types].xml": '<Types><Override PartName="/xl/calcChain.xml" ContentType="x"/><Override PartName="/xl/workbook.xml" ContentType="y"/></Types>',
    "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{xlsx.LINKS}"><sheets><sheet name="Notes" sheetId="1" r:id="rId2"/><sheet name="Questions" sheetId="2" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{xlsx.PARTS}"><Relationship Id="rId1" Type="{xlsx.LINKS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{xlsx.LINKS}/worksheet" Target="/xl/worksheets/notes.xml"/><Relationship Id="rId3" Type="{xlsx.LINKS}/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="rId4" Type="{xlsx.LINKS}/calcChain" Target="calcChain.xml"/></Relationships>',
    "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}"><si><t>Subject</t></si><si><r><t>Q_file</t></r><r><t xml:space="preserve">name_x0020_</t></r></si><si><t>Auto</t></si></sst>',
    "xl/worksheets/sheet1.xml": SHEET,
    "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships xmlns="{xlsx.PARTS}"><Relationship Id="rId1" Type="{xlsx.LINKS}/table" Target="../tables/table1.xml"/></Relationships>',
    "xl/worksheets/notes.xml": f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>',
    "xl/tables/table1.xml": f'<table xmlns="{MAIN}" id="1" name="T" ref="A1:K3"><autoFilter ref="A1:K3"/></table>',
    "xl/calcChain.xml": "<calcChain/>",
    "xl/theme/theme1.xml": "<theme>as it is</theme>",
}


def book(parts=PARTS):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    out.seek(0)
    return out


def values(file):
    return {(r[0], r[2], r[3]): r[4:] for r in xlsx.read_book(file) if r[4] != "sheet"}


def test_cells_of_a_workbook():
    got = values(book())
    assert got["Questions", 1, 1][:2] == ("text", "Subject") and got["Questions", 1, 2][1] == "Q_filename " and got["Questions", 1, 4][:3] == ("text", "MS filename", '"MS "&"filename"')
    assert got["Questions", 2, 2][1] == "a_q1_Q.png" and got["Questions", 2, 3][:2] == ("number", "7") and got["Questions", 2, 11][:2] == ("boolean", "1")
    assert [got["Questions", r, 10][2] for r in (2, 3, 4)] == ["B2&$A$1", "B3&$A$1", "B4&$A$1"]
    assert got["Questions", 3, 1] == (None, None, None, 3)
    assert [(r[0], r[1]) for r in xlsx.read_book(book()) if r[4] == "sheet"] == [("Notes", 0), ("Questions", 1)]


@pytest.mark.parametrize("piece", [7, 1 << 16])
def test_a_workbook_changes_where_it_is_written(monkeypatch, piece):
    monkeypatch.setattr(xlsx, "PIECE", piece)
    Cell = xlsx.Cell
    cells = [Cell(2, 3, "number", "9", None, None), Cell(2, 10, "text", "gone", None, None), Cell(3, 2, "text", " <b> & _x0041_\r ", None, 8), Cell(3, 1, "style", None, None, 9), Cell(6, 10, "number", None, "B6&\"x\"", None), Cell(9, 30, "boolean", "0", None, None)]
    rows: dict = {}
    for c in cells:
        rows.setdefault(c.row, {})[c.col] = c
    out = io.BytesIO()
    xlsx.patch_book(book(), out, {"Questions": rows, "Notes": {2: {1: Cell(2, 1, "text", "note", None, None)}}})
    out.seek(0)
    got, old = values(out), values(book())
    assert got["Questions", 2, 3] == ("number", "9", None, None) and got["Questions", 2, 10] == ("text", "gone", None, 5)
    assert got["Questions", 3, 2] == ("text", " <b> & _x0041_\r ", None, 8) and got["Questions", 3, 1] == (None, None, None, 9)
    # The formula that others shared is gone; they keep theirs.
    assert [got["Questions", r, 10][2] for r in (3, 4, 6)] == ["B3&$A$1", "B4&$A$1", 'B6&"x"'] and got["Questions", 9, 30][:2] == ("boolean", "0")
    touched = {("Questions", c.row, c.col) for c in cells} | {("Notes", 2, 1)}
    assert {k: v for k, v in got.items() if k not in touched} == {k: v for k, v in old.items() if k not in touched}
    with zipfile.ZipFile(out) as z:
        assert z.read("xl/theme/theme1.xml") == b"<theme>as it is</theme>" and "xl/calcChain.xml" not in z.namelist()
        assert b"calcChain" not in z.read("[Content_Types].xml") + z.read("xl/_rels/workbook.xml.rels")
        assert z.read("xl/tables/table1.xml").count(b'ref="A1:K9"') == 2
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert 'dimension ref="A1:AD9"' in sheet and '<row r="3" ht="20">' in sheet and sheet.endswith("</tableParts></worksheet>")
    with pytest.raises(ValueError, match="no sheet"):
        xlsx.patch_book(book(), io.BytesIO(), {"Other": rows})


def test_a_long_sheet_goes_round(spark, tmp_path):
    root = f"file://{tmp_path}/books"
    ids = spark.range(1, 6001).select(F.col("id").cast("int").alias("row"))
    kinds = F.array(
        F.struct(F.lit(1).alias("col"), F.lit("text").alias("kind"), F.concat(F.lit("t & <"), "row").alias("value"), F.lit(None).cast("string").alias("formula")),
        F.struct(F.lit(2).alias("col"), F.lit("number").alias("kind"), (F.col("row") / 4).cast("string").alias("value"), F.lit(None).cast("string").alias("formula")),
        F.struct(F.lit(28).alias("col"), F.lit("number").alias("kind"), F.lit(None).cast("string").alias("value"), F.concat(F.lit("B"), "row", F.lit("*2")).alias("formula")),
    )
    cells = ids.select(F.explode(F.array(F.lit("one"), F.lit("sub/two"))).alias("book"), F.lit("Data").alias("sheet"), "row").select("book", "sheet", "row", F.explode(kinds).alias("x")).select("book", "sheet", "row", "x.*").withColumn("style", F.lit(None).cast("int"))
    sinks.write_cells(cells.repartition(5), root)
    back = readers.cells(spark, root)
    assert back.where("kind = 'sheet'").count() == 2
    same = back.where("row > 0").select(*cells.columns)
    assert same.count() == 36_000 and same.exceptAll(cells).count() == 0
    more = cells.where("row = 77 and col = 1 and book = 'one'").withColumn("value", F.lit("new"))
    sinks.write_cells(more, f"file://{tmp_path}/changed", base=root)
    changed = readers.cells(spark, f"file://{tmp_path}/changed").where("row > 0").select(*cells.columns)
    assert [tuple(r)[:5] for r in changed.exceptAll(cells).collect()] == [("one", "Data", 77, 1, "text")] and changed.count() == 18_000
    assert sorted(os.listdir(tmp_path / "books")) == ["one.xlsx", "sub"]
    (tmp_path / "books" / "bad.xlsx").write_bytes(b"PK no zip")
    with pytest.raises(Exception, match="bad.xlsx"):
        readers.cells(spark, root).count()


def test_entries_get_their_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.xlsx").write_bytes(book().getvalue())
    root = f"file://{tmp_path}/in"
    cells = readers.cells(spark, root)
    entries = spark.createDataFrame(
        [("b", 1, "physics", "new1_Q.png", 5, ""), ("b", 2, "", "A_Q1_q.PNG", 8, "a_q1_MS.png"), ("b", 3, "maths", "new2_Q.png", None, "new2_MS.png"), ("b", 4, "", "new1_Q.png", 6, "new1_MS.png"), ("b", 5, "x", "", 1, ""), ("no such", 6, "x", "y_Q.png", 1, "")],
        "book string, seq int, subject string, q_filename string, marks int, ms_filename string",
    )
    updates, placed = workbook.additions(cells, entries)
    assert {(r["stem"], r["row"], r["updated"]) for r in placed.collect()} == {("a_q1", 2, True), ("new1", 3, False), ("new2", 4, False)}
    sinks.write_cells(updates, f"file://{tmp_path}/out", base=root)
    got = {(r["row"], r["col"]): (r["value"], r["formula"], r["style"]) for r in readers.cells(spark, f"file://{tmp_path}/out").where("sheet = 'Questions' and row > 0").collect()}
    assert got[2, 2] == ("A_Q1_q.PNG", None, 4) and got[2, 3][0] == "8" and got[2, 4][0] == "a_q1_MS.png" and got[2, 1] == ("physics", None, 3)
    assert got[3, 1] == ("physics", None, 3) and got[3, 2] == ("new1_Q.png", None, 4) and got[3, 3][0] == "6" and got[3, 4][0] == "new1_MS.png"
    assert got[4, 1] == ("maths", None, 3) and (4, 3) not in got and got[4, 10][1] == "B4&$A$1" and got[3, 10][1] == "B3&$A$1"
    more = spark.createDataFrame([("b", k, "physics", f"n{k}_Q.png", k, "") for k in range(6)], entries.schema)
    updates, _ = workbook.additions(cells, more)
    down = {(r["row"], r["col"]): r["formula"] for r in updates.where("formula is not null").collect()}
    assert down == {(r, 10): f"B{r}&$A$1" for r in (5, 6, 7, 8)}  # rows 3 and 4 have theirs
    with zipfile.ZipFile(tmp_path / "out" / "b.xlsx") as z:
        assert b'ref="A1:K4"' in z.read("xl/tables/table1.xml")

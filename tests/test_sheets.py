"""Spreadsheet files: round trips, foreign workbooks, commits."""

import io
import os
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from panelstats.sources import sheets
from panelstats.sources.scan import typed_scores


def test_round_trip_of_types(spark, tmp_path):
    rows = [(1, 2.5, "a <b> & c\n d", date(2021, 3, 5), datetime(2021, 10, 5, 7, 30), True), (None, None, None, None, None, None),
            (-7, 1e-300, " é😀", date(1999, 12, 31), datetime(2000, 1, 1), False), (3, float("nan"), "", None, None, None)]
    df = spark.createDataFrame(rows, "i long, x double, s string, d date, t timestamp, b boolean").repartition(3)
    path = sheets.write_sheets(df, str(tmp_path / "out"))
    back = sheets.read_sheets(spark, path)
    assert back.columns == df.columns and set(t for _, t in back.dtypes) == {"string"}
    got = {r["i"]: tuple(r)[1:] for r in back.collect()}
    assert got["1"] == ("2.5", "a <b> & c\n d", "2021-03-05", "2021-10-05 07:30:00", "TRUE")
    assert got["-7"] == ("1e-300", " é😀", "1999-12-31", "2000-01-01", "FALSE") and got["3"] == (None, "", None, None, None)
    assert len(got) == 3  # a row without any cell is no row
    assert all(f.endswith(".xlsx") for f in os.listdir(path))


def test_files_roll_and_overwrite_replaces(spark, tmp_path):
    path = str(tmp_path / "out")
    sheets.write_sheets(spark.range(25).coalesce(1), path, maxrows=10)
    assert len(os.listdir(path)) == 3
    assert sorted(int(r.id) for r in sheets.read_sheets(spark, path).collect()) == list(range(25))
    sheets.write_sheets(spark.range(3).coalesce(1), path, mode="append")
    assert sheets.read_sheets(spark, path).count() == 28
    sheets.write_sheets(spark.range(4).coalesce(1), path)
    assert sheets.read_sheets(spark, path).count() == 4


def test_failed_job_leaves_no_workbook(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(Exception):
        sheets.write_sheets(spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("id").cast("string")).alias("x")), path)
    assert not [f for f in (os.listdir(path) if os.path.isdir(path) else []) if f.endswith(".xlsx")]


def book(sheet: str, shared: str | None = None, styles: str = "", props: str = "") -> bytes:
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{props}'
                   '<sheets><sheet name="A" sheetId="4" r:id="x9"/><sheet name="B" sheetId="5" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="x1" Target="worksheets/b.xml"/><Relationship Id="x9" Target="/xl/worksheets/a.xml"/></Relationships>')
        z.writestr("xl/worksheets/a.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr("xl/worksheets/b.xml", f"<worksheet {main}><sheetData/></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {main}>{shared}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {main}>{styles}</styleSheet>")
    return out.getvalue()


def test_a_workbook_as_spreadsheet_programs_write_it(spark, tmp_path):
    """Shared and rich strings, date styles of both kinds, sparse rows, errors, repeated names: the
    cell that became a date is repaired to the score it was."""
    sheet = ('<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>1</v></c></row>'
             '<row><c r="A2"><v>7</v></c><c r="B2" s="1"><v>44260</v></c><c r="C2" t="str"><v>f</v></c><c r="D2" s="2"><v>59.5</v></c></row>'
             '<row><c r="D3" t="e"><v>#N/A</v></c><c r="E3"><v>1</v></c></row><row/><row><c r="B5"><v>5.3</v></c></row>')
    styles = ('<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm hh:mm"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts>'
              '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>')
    shared = "<si><t>Ponto</t></si><si><r><t>Co</t></r><r><t>bert</t></r><rPh><t>x</t></rPh></si>"
    (tmp_path / "a.xlsx").write_bytes(book(sheet, shared, styles))
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    df = sheets.read_sheets(spark, str(tmp_path))
    assert df.columns == ["Ponto", "Cobert", "Unnamed: 2", "Cobert.1"]
    rows = [tuple(r) for r in df.collect()]
    assert rows == [("7", "2021-03-05", "f", "1900-02-28 12:00:00"), (None, None, None, None), (None, "5.3", None, None)]
    assert [r.Cobert for r in typed_scores(df.select("Cobert"), ["Cobert"], repair_dates=True).collect()] == [5.3, None, 5.3]
    one = sheets.read_sheets(spark, str(tmp_path / "a.xlsx"), "Cobert string, nowhere string")
    assert [tuple(r) for r in one.collect()][0] == ("2021-03-05", None)


def test_dates_count_from_1904_where_the_book_says_so():
    sheet = '<row><c r="A1" t="inlineStr"><is><t>d</t></is></c></row><row><c r="A2" s="0"><v>1</v></c></row>'
    rows = list(sheets.sheet_rows(io.BytesIO(book(sheet, None, '<cellXfs><xf numFmtId="22"/></cellXfs>', '<workbookPr date1904="1"/>'))))
    assert rows == [["d"], ["1904-01-02"]]


def test_folder_without_workbooks(spark, tmp_path):
    with pytest.raises(Exception):
        sheets.read_sheets(spark, str(tmp_path)).count()

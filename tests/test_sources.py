import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import tables


@pytest.fixture
def book(tmp_path):
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    path = str(tmp_path / "book.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Act</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    return path


def test_xlsx(spark, book):
    want = [("One", 0, ["Act", "", "5", ""]), ("One", 1, ["", "x", "", ""])]
    assert [(r.sheet, r.row, r.cells) for r in tables.read_xlsx(spark, book, 4).orderBy("row").collect()] == want
    spark.dataSource.register(tables.XlsxSource)
    got = spark.read.format("lodestrata_xlsx").option("path", book).option("width", 4).load()
    assert [tuple(r) for r in got.orderBy("row").collect()] == want
    assert tables.column_index("AB") == 27


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("| Economy | Indicator |\n|---|---|\n| X | 6.1 |\n| X | 6.1 |\n| broken |\n\n| Other |\n|---|\n| 1 |\n")
    got = tables.read_markdown_table(spark, str(tmp_path / "a.md"), ["Economy", "Indicator"]).collect()
    assert [r.cells for r in got] == [{"Economy": "X", "Indicator": "6.1"}]


def test_artifacts(spark, tmp_path):
    (tmp_path / "ok.html").write_text("<html>" + "text " * 20)
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 " + b"x" * 50)
    (tmp_path / "tiny.html").write_text("x")
    got = {r.path.rpartition("/")[2]: r.fault for r in tables.read_artifacts(spark, str(tmp_path)).collect()}
    assert got == {"ok.html": None, "bad.pdf": "cut off", "tiny.html": "too short"}


def test_evidence_csv(spark, tmp_path):
    rows = spark.createDataFrame([tuple("a,\"b\"\nc" if c == "snippet" else None for c in tables.EVIDENCE_COLUMNS)], ", ".join(f"{c} string" for c in tables.EVIDENCE_COLUMNS))
    tables.write_evidence_csv(rows, str(tmp_path / "out"))
    back = spark.read.option("multiLine", True).option("escape", "\\").csv(str(tmp_path / "out"), header=True).collect()
    assert back[0].snippet.startswith("a,") and list(back[0].asDict()) == list(tables.EVIDENCE_COLUMNS)
    with pytest.raises(ValueError):
        tables.write_evidence_csv(rows.drop("tag"), str(tmp_path / "no"))


def test_append_once(spark):
    ledger = spark.createDataFrame([("a", "1")], "k string, v string")
    same = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], "k string, v string")
    assert [tuple(r) for r in tables.append_once(ledger, same, "k", ["v"]).collect()] == [("b", "2")]
    with pytest.raises(ValueError):
        tables.append_once(ledger, spark.createDataFrame([("a", "9")], "k string, v string"), "k", ["v"])


def test_quarantine(spark):
    good, bad = tables.quarantine(spark.range(4), F.when(F.col("id") > 2, "large"))
    assert good.count() == 3 and [r.reason for r in bad.collect()] == ["large"]


def test_known_rows(spark):
    cells = [("p", "s", 0, ["title", "", "", ""]), ("p", "s", 1, ["Act name", "Indicator", "Score", "Reference 1"]), ("p", "s", 2, ["Data Act; Privacy Act", "6.4", "1", "s. 5"]), ("p", "s", 3, ["", "6.1", "0", ""])]
    rows = spark.createDataFrame(cells, "path string, sheet string, row int, cells array<string>")
    got = tables.known_rows(tables.named_rows(rows), F.lit("X")).collect()
    assert [(r.indicator, r.act, r.score, r.references) for r in got] == [("P6-I4", "Data Act", "1", ["s. 5"]), ("P6-I4", "Privacy Act", "1", ["s. 5"])]

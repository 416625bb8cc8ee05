import datetime as dt
import os
import zipfile

import pytest

from tamarisk.operators import export
from tamarisk.sources import files, workbook

META = "بيانات المنتج"


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        (1, "عطر <&> \x01 _x0041_\r\nb", 1.5, True, dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 12, 30, 5)),
        (2, None, None, None, None, None),
        (3, " x ", float("inf"), False, dt.date(1800, 1, 1), None),
        (10**17, "", 1e20, None, None, None),
    ]
    return spark.createDataFrame(rows, "id long, `الاسم` string, v double, b boolean, d date, t timestamp").coalesce(1)


def test_typed_cells_come_back(spark, mixed, tmp_path):
    path = str(tmp_path / "books")
    workbook.write_workbooks(mixed, path, "ورقة", META, rows=3)
    assert len(workbook.files(path)) == 2
    back = workbook.read_workbook(spark, path, "ورقة", META)
    assert back.columns == mixed.columns
    assert sorted(tuple(r) for r in back.collect()) == sorted(
        [
            ("1", "عطر <&> \x01 _x0041_\r\nb", "1.5", "true", "2024-02-29", "2024-02-29 12:30:05"),
            ("2", None, None, None, None, None),
            ("3", " x ", "inf", "false", "1800-01-01", None),
            (str(10**17), "", "1e+20", None, None, None),
        ],
        key=str,
    )
    assert workbook.read_workbook(spark, path, "another", META).columns == []


def test_overwrite_append_and_nothing(spark, mixed, tmp_path):
    path = str(tmp_path / "books")
    for mode, n in (("append", 4), ("append", 8), ("overwrite", 4)):
        workbook.write_workbooks(mixed, path, mode=mode)
        assert workbook.read_workbook(spark, path).count() == n
    assert not [n for n in os.listdir(path) if n.startswith(".")]
    workbook.write_workbooks(mixed.where("false"), path, mode="overwrite")
    assert workbook.files(path) == []
    with pytest.raises(Exception, match="no workbook"):
        workbook.read_workbook(spark, path)


def test_failed_tasks_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "books")
    long = spark.createDataFrame([("x" * 40_000,)], "c string")
    with pytest.raises(Exception, match="characters at most"):
        workbook.write_workbooks(long, path)
    assert workbook.files(path) == []


def _book(path, sheet: str, shared: str = "", styles: str = "") -> None:
    """A workbook with two sheets as other programs write them: shared texts, absolute part names, dates by style."""
    main, rel = workbook.MAIN, workbook.RELATIONS
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="one" r:id="a"/><sheet name="two" r:id="b"/></sheets></workbook>')
        links = '<Relationship Id="a" Target="/xl/worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbook.PACKAGE}">{links}</Relationships>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{shared}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}">{styles}</styleSheet>')


def test_foreign_workbooks(spark, tmp_path):
    shared = "<si><t>name</t></si><si><t>price</t></si><si><r><t>Oud </t></r><r><t>Royal</t></r><rPh><t>no</t></rPh></si>"
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts>'
    styles += '<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="s"><v>1</v></c></row>'
    body = '<row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3" s="1"><v>45351</v></c><c r="D3" s="2"><v>45351</v></c></row>'
    body += '<row r="4"><c r="A4"/></row><row r="5"><c t="str"><f>A1</f><v>made</v></c><c t="b"><v>0</v></c><c t="e"><v>#N/A</v></c></row>'
    _book(tmp_path / "a.xlsx", head + body, shared, styles)
    back = workbook.read_workbook(spark, str(tmp_path), "two")
    assert back.columns == ["name", "_c1", "price", "price_3"]
    assert sorted(tuple(r) for r in back.collect()) == [("Oud Royal", None, "2024-02-29", "45351"), ("made", "false", "#N/A", None)]
    _book(tmp_path / "b.xlsx", '<row><c t="inlineStr"><is><t>price</t></is></c></row><row><c><v>7</v></c></row>')
    assert ("7", None) in {(r.price, r.name) for r in workbook.read_workbook(spark, str(tmp_path), "two").select("price", "name").collect()}


def test_column_letters():
    assert [workbook.column_number(workbook.column_letters(n) + "7") for n in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]
    assert workbook.sheet_name("a/b" + "c" * 40) == "a b" + "c" * 28 and workbook.sheet_name("??") == "Sheet1"


def test_sheets_of_an_export(spark, mixed, tmp_path):
    export.write_sheets({"all": mixed.select("id", "v"), "x/y": mixed.select("id")}, str(tmp_path), workbooks=True)
    assert workbook.read_workbook(spark, str(tmp_path / "all"), "all").count() == 4
    assert workbook.read_workbook(spark, str(tmp_path / "x y"), "x y").columns == ["id"]


def test_encoding_is_told_from_the_whole_file(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"name,price\n" + b"plain,1\n" * 5000 + "عطر,2\n".encode("windows-1256"))
    rows = files.read_csv(spark, str(path), encoding=None)
    assert rows.where("name = 'عطر'").count() == 1 and rows.count() == 5001


def test_roles_are_told_from_the_whole_file(spark):
    rows = [("", "n/a", "a long name of nothing", "")] * 100 + [(f"https://x/{i}.jpg", f"{i}.5", f"scent {i}", f"https://x/{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    assert files.infer_roles(df) == {"image": "a", "link": "d", "price": "b", "name": "c"}
    assert files.infer_roles(df.where("false")) == {"name": "a"}


def test_posting_waits_longer_after_each_failure(spark, tmp_path):
    import time

    log = str(tmp_path / "log")

    def poster(products):
        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        return False

    batched = spark.createDataFrame([("b", ["p"])], "batch string, products array<string>")
    row = export.send(batched, poster, retries=3, pause=0.1).first()
    assert (row.sent, row.attempts) == (False, 3)
    at = [float(x) for x in open(log)]
    assert at[1] - at[0] >= 0.1 and at[2] - at[1] >= 0.2

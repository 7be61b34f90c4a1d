"""Workbooks and tagged text."""

import zipfile

import pytest

from quire.operators.export import write_lines
from quire.sources.files import LONG, WORKS_HEADERS, header_problems, read_document, read_tagged_text, read_workbooks, tagged_dialects
from quire.sources.workbooks import register, write_workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Cat No</t></si><si><t>Title</t></si><si><r><t>Sun</t></r><r><t>set</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf/><xf quotePrefix="1"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c></row><row r="4"><c r="A4"><v>2.5</v></c><c r="B4" t="inlineStr" s="1"><is><t>quoted</t></is></c></row></sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    rows = read_workbooks(spark, str(tmp_path / "*.xlsx")).orderBy("row_number").collect()
    assert [(r.row_number, r.cells.get("Cat No"), r.cells.get("Title")) for r in rows] == [(2, "1", "Sunset"), (3, None, None), (4, "2.5", "'quoted")]
    assert read_workbooks(spark, str(tmp_path / "*.xlsx"), skip_blank=True).count() == 2


def test_headers():
    missing, optional = header_problems(["Cat Nos", "Title"], WORKS_HEADERS)
    assert missing == ["Cat No (is it Cat Nos?)", "Artist"] and "Gallery" in optional


def test_tagged_text(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes("<pstyle:a>é\r<pstyle:b>x".encode("mac_roman"))
    assert [r.paragraph for r in read_tagged_text(spark, str(tmp_path / "t.txt")).orderBy("ord").collect()] == ["<pstyle:a>é", "<pstyle:b>x"]
    (tmp_path / "u.txt").write_bytes(b"<ParaStyle:a>1\r\n<ParaStyle:b>2\r\n")
    assert [r.paragraph for r in read_tagged_text(spark, str(tmp_path / "u.txt")).orderBy("ord").collect()] == ["<ParaStyle:a>1", "<ParaStyle:b>2", ""]


def test_tagged_text_in_splits(spark, tmp_path):
    """One file over many tasks, in both dialects: paragraphs in order, none lost or cut."""
    special = bytes(range(128, 256)).decode("mac_roman")
    paragraphs = [f"{i} {special[i % 128]} " + "x" * (i * 7 % 90) for i in range(400)]
    (tmp_path / "long").mkdir()
    (tmp_path / "short").mkdir()
    for name in ("a", "b"):
        (tmp_path / "long" / f"{name}.txt").write_bytes("\r".join(f"<ParaStyle:S>{name}{p}" for p in paragraphs).encode("mac_roman"))
        (tmp_path / "short" / f"{name}.txt").write_bytes(("<ASCII-MAC>\r" + "".join(f"<pstyle:S>{name}{p}\r" for p in paragraphs)).encode("mac_roman"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "500")
    try:
        for short, head, end in ((False, "<ParaStyle:S>", ""), (True, "<pstyle:S>", "\r")):
            folder = str(tmp_path / ("short" if short else "long"))
            rows = read_document(spark, folder, short=short)
            assert rows.rdd.getNumPartitions() > 4 or read_tagged_text(spark, folder, short=short).rdd.getNumPartitions() > 4
            got = [r.paragraph for r in rows.orderBy("ord").collect()]
            lead = ["<ASCII-MAC>\r"] if short else []
            assert got == [x for name in "ab" for x in [*lead, *(f"{head}{name}{p}{end}" for p in paragraphs)]]
            assert {r.short for r in tagged_dialects(spark, folder).collect()} == {short}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_packed_splits_are_refused(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionNum", "3")
    try:
        with pytest.raises(ValueError):
            read_tagged_text(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionNum")


def test_written_lines_are_mac_roman(spark, tmp_path):
    text = "a£…é" + bytes(range(128, 256)).decode("mac_roman") + "Ł日"
    df = spark.createDataFrame([(1, 1, text), (1, 0, "head")], "section_position int, position long, line string")
    write_lines(df, str(tmp_path / "out"), LONG, "mac_roman")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert data.decode("mac_roman") == "head\r" + text.replace("Ł", "<0x0141>").replace("日", "<0x65E5>") + "\r"


def test_workbook_source(spark, tmp_path):
    register(spark)
    source = lambda **options: spark.read.format("workbook").options(**options)
    (tmp_path / "none").mkdir()
    assert source(layout="works").load(str(tmp_path / "none")).count() == 0
    rows = [(i, str(i), f" t<{i}>&\n" if i % 3 else None, "" if i % 2 else "A é") for i in range(25)]
    df = spark.createDataFrame(rows, "ord long, `Cat No` string, Title string, Artist string")
    for _ in range(2):  # written again, the files are the same
        names = write_workbooks(df, str(tmp_path / "b"), most=10).collect()
    assert sorted((r.name, r.rows) for r in names) == [("000000000000.xlsx", 10), ("000000000001.xlsx", 10), ("000000000002.xlsx", 5)]
    read = source(layout="works").load(str(tmp_path / "b"))
    assert read.rdd.getNumPartitions() == 3 and read.columns == ["path", "row_number", *WORKS_HEADERS]
    got = sorted(((int(r["Cat No"]), r.Title, r.Artist, r.Price, r.row_number) for r in read.collect()), key=lambda r: r[0])
    assert got == [(i, t, a, None, i % 10 + 2) for i, _, t, a in rows]
    pruned = source().schema("Title string, Nothing string").load(str(tmp_path / "b"))
    assert sorted(map(tuple, pruned.collect()), key=str) == sorted(((t, None) for _, _, t, _ in rows), key=str)
    assert source(layout="works", skipBlank="true").load(str(tmp_path / "b")).count() == 25
    write_workbooks(df.drop("Artist"), str(tmp_path / "bad")).collect()
    with pytest.raises(Exception, match="lacks Artist"):
        source(layout="works").load(str(tmp_path / "bad")).collect()
    assert [r.cells for r in read_workbooks(spark, str(tmp_path / "bad")).limit(1).collect()] == [{"Cat No": "0", "Title": None}]

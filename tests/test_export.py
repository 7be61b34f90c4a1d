"""Export, tagged text, reconcile, the artist index and re-imports on literal rows."""

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quire.config import Component, IndexLayout, Layout, Reconcile
from quire.operators import artists, export, match, ordering, reconcile, reimport, report, tags, works
from quire.plans.queries import QUERIES
from quire.sources.files import header_report, read_workbooks
from quire.sources.views import view

SF = "/root/testdata/sf0.001"
ROWS = "section string, section_position int, ord long, number string, artist string, honorifics string, title string, title_cased string, price_numeric long, price_text string, edition_total int, edition_price_numeric long, artwork int, medium string"


def work(number, title, ord=1, section="Room", place=1, artist="Jane Doe", honorifics=None, price=None, text="", total=None, each=None, medium=None):
    return (section, place, ord, number, artist, honorifics, title, None, price, text, total, each, None, medium)


def lines_of(document):
    return [r.line for r in document.orderBy("section_position", "position").collect()]


def test_wrap():
    assert export.wrap_text("one two three four", 9) == ["one two ", "three ", "four"]
    assert export.wrap_text("abcdefghij", 4) == ["abcd", "efgh", "ij"]
    assert export.wrap_text("see (the end", 6) == ["see ", "(the ", "end"]
    assert export.wrap_text("aa – bb cc", 6) == ["aa ", "– bb ", "cc"]
    assert export.balanced_lines("aaa bbb ccc ddd eee", 17) == ["aaa bbb ccc ", "ddd eee"]
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("ab  (),–'") for _ in range(rng.randint(0, 40))).strip()
        for fit in (export.wrap_text, export.balanced_lines):
            lines = fit(text, 8)
            assert "".join(lines) == text and all(len(x) <= 8 for x in lines) and len(lines) <= len(export.wrap_text(text, 8))


def test_inline_entries(spark):
    rows = spark.createDataFrame([work("1", "A > B", honorifics="RA", price=1200, total=7, each=920), work("2", "", 2, text="NFS", medium="oil\\x"), work(None, "Last", 3)], ROWS)
    got = lines_of(export.tagged_lines(rows))
    assert got == [
        "<ASCII-MAC>",
        "<ParaStyle:SectionTitle>Room",
        "<ParaStyle:CatalogueEntry><CharStyle:CatNo>1<CharStyle:>\t<CharStyle:ArtistName>Jane Doe<CharStyle:> <CharStyle:Honorifics>RA<CharStyle:>\t<CharStyle:WorkTitle>A \\> B<CharStyle:>\t<CharStyle:Edition>(edition of 7 at £920)<CharStyle:>\t<CharStyle:Price>£1,200<CharStyle:>",
        "<ParaStyle:CatalogueEntry><CharStyle:CatNo>2<CharStyle:>\t<CharStyle:ArtistName>Jane Doe<CharStyle:>\t<CharStyle:Price>NFS<CharStyle:><CharStyle:Medium>oil\\\\x<CharStyle:>",
        "<ParaStyle:CatalogueEntry><CharStyle:ArtistName>Jane Doe<CharStyle:>\t<CharStyle:WorkTitle>Last<CharStyle:>\t",
        "",
    ]
    assert lines_of(export.tagged_lines(rows.limit(0))) == ["<ASCII-MAC>"]


def test_wrapped_entries(spark):
    plain = replace(Layout(), styles={"title": "T"}, section_style="", section_separator="none")
    rows = spark.createDataFrame([work("1", "one two three", medium="oil")], ROWS)
    parts = (Component("title", "tab", max_line=8, next_after_first_line=True), Component("artist", "space"), Component("medium", "none"))
    assert lines_of(export.tagged_lines(rows, replace(plain, components=parts)))[1:] == ["<ParaStyle:CatalogueEntry><CharStyle:T>one two <CharStyle:>\tJane Doe<CharStyle:T>\nthree<CharStyle:> oil"]
    parts = (Component("title", "tab", max_line=8), Component("artist", "space"), Component("price", "hard_return"))
    layout = replace(plain, components=parts, final_separator_from_last=True, trailing="tab")
    assert lines_of(export.tagged_lines(rows, layout))[1:] == ["<ParaStyle:CatalogueEntry><CharStyle:T>one two \nthree<CharStyle:>\tJane Doe\r<ParaStyle:CatalogueEntry>\t"]
    own = spark.createDataFrame([work("1", "own\n breaks are kept")], ROWS)
    assert lines_of(export.tagged_lines(own, layout))[1].startswith("<ParaStyle:CatalogueEntry><CharStyle:T>own\nbreaks are kept<CharStyle:>\t")


def test_paragraph_entries(spark):
    parts = (Component("work_number", "space", paragraph="N"), Component("title"), Component("edition", paragraph="E"), Component("price", paragraph="P", omit_when_empty=False))
    layout = replace(Layout(), styles={}, components=parts, section_separator="none")
    rows = spark.createDataFrame([work("1", "x"), work("2", "y", 2, total=3)], ROWS)
    assert lines_of(export.tagged_lines(rows, layout))[2:] == ["<ParaStyle:N>1 x\r<ParaStyle:P>", "<ParaStyle:N>2 y\r<ParaStyle:E>(edition of 3)\r<ParaStyle:P>"]


def test_other_formats(spark):
    import csv
    import io
    import json
    import xml.etree.ElementTree as ET

    rows = spark.createDataFrame([work("1", 'a "b", <c> & d\ne', price=5), work("2", "x", 2, medium="oil"), work("3", "y", 3, 'R "2" & <x>', 2)], ROWS)
    document = json.loads("".join(lines_of(export.json_lines(rows))))
    assert [(s["section_name"], s["position"], [w["number"] for w in s["works"]]) for s in document["sections"]] == [("Room", 1, ["1", "2"]), ('R "2" & <x>', 2, ["3"])]
    assert document["sections"][0]["works"][0]["title"] == 'a "b", <c> & d\ne' and document["sections"][0]["works"][0]["medium"] is None
    root = ET.fromstring("".join(lines_of(export.xml_lines(rows))))
    assert [s.get("name") for s in root] == ["Room", 'R "2" & <x>'] and root[0][0].find("title").text == 'a "b", <c> & d\ne' and root[0][0].find("medium").text is None
    table = list(csv.DictReader(io.StringIO("\n".join(lines_of(export.csv_lines(rows))))))
    assert [t["title"] for t in table] == ['a "b", <c> & d\ne', "x", "y"] and table[0]["price_numeric"] == "5" and table[0]["medium"] == ""


def test_empty_sections_are_kept(spark):
    df = spark.createDataFrame([(1, "A", "1", "t", "n", None, None, "", None, None, None, False), (2, "B", "2", "t", "n", None, None, "", None, None, None, True)], "ord long, gallery string, cat_no string, title string, artist_name string, artist_honorifics string, price_numeric long, price_text string, edition_total int, edition_price long, medium string, include_in_export boolean")
    got = lines_of(export.tagged_lines(export.collected(df)))
    assert [x for x in got if "SectionTitle" in x] == ["<ParaStyle:SectionTitle>A", "<ParaStyle:SectionTitle>B"] and sum("CatalogueEntry" in x for x in got) == 1


def walked(body):
    """Content without escapes and tags, by a walk."""
    out, i = "", 0
    while i < len(body):
        if body[i] == "\\" and i + 1 < len(body):
            out, i = out + body[i + 1], i + 2
        elif body[i] == "<" and ">" in body[i:]:
            end = body.index(">", i)
            tag = body[i + 1 : end]
            out += chr(int(tag[2:], 16)) if len(tag) > 2 and tag[:2] == "0x" and all(c in "0123456789abcdefABCDEF" for c in tag[2:]) else ""
            i = end + 1
        else:
            out, i = out + body[i], i + 1
    return out


def test_decoding(spark):
    rng = random.Random(3)
    bodies = ["".join(rng.choice(["a", "<", ">", "\\", "<0x00E9>", "<0x1F600>", "<ccase:upper>", "é", "\n", "<0x000A>"]) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, b string")
    assert [r.x for r in df.orderBy("i").select(tags.decoded(F.col("b")).alias("x")).collect()] == [walked(b) for b in bodies]


def test_parsing_both_dialects(spark):
    long = "<ASCII-MAC>\r<ParaStyle:SectionTitle>Large\nWeston works 12-30.\r<ParaStyle:CatalogueEntry><CharStyle:CatNo>7<CharStyle:>\t<CharStyle:ArtistName>Zoë <0x0026> co<CharStyle:>\t<CharStyle:WorkTitle>A \\> <0x000A>B<CharStyle:>\r<ParaStyle:Other>no\r<ParaStyle:CatalogueEntry><CharStyle:WorkTitle>no number<CharStyle:>\r"
    short = "<vsn:8>\n<pstyle:SectionTitle>One \x03<pstyle:CatalogueEntry><cstyle:CatNo>8<cstyle:>\t<cstyle:WorkTitle>first <cstyle:><cstyle:WorkTitle>second<cstyle:>\n<pstyle:CatalogueEntry><cstyle:CatNo> 9 <cstyle:>"
    found = tags.parsed_entries(tags.paragraphs(spark.createDataFrame([("l", long), ("s", short)], "document string, text string")))
    got = {(r.document, r.cat_no): (r.section, r.artist, r.title) for r in found.collect()}
    assert got == {("l", "7"): ("Large Weston", "Zoë & co", "A > B"), ("s", "8"): ("One", None, "first second"), ("s", "9"): ("One", None, None)}


def test_shared_styles(spark):
    layout = replace(Layout(), styles={"work_number": "X", "title": "X", "medium": "X", "artist": "A"})
    text = "<ParaStyle:CatalogueEntry><CharStyle:X>5\t<ccase:upper>Title<CharStyle:><CharStyle:A>Jo<CharStyle:><CharStyle:X>\t<CharStyle:><CharStyle:X>oil <CharStyle:><CharStyle:X>on board<CharStyle:>"
    row = tags.parsed_entries(tags.paragraphs(spark.createDataFrame([("d", text)], "document string, text string")), layout).first()
    assert (row.cat_no, row.title, row.medium, row.artist) == ("5", "Title", "oil on board", "Jo")


def test_reconcile(spark):
    kind = "cat_no string, ord long, section string, artist string, honorifics string, title string, edition string, price string, medium string"
    data = [("1", 1, "A", "Jo", None, 'The "x"', "", "£5", "oil"), ("2", 2, "A", "Al", None, "b", "", "", "a\nb"), ("3", 3, "A", "Cy", None, "c", "", "", ""), ("4", 4, "B", "Di", None, "d", "", "", ""), ("10", 5, "B", "Ed", None, "e", "", "", "")]
    printed = [("1", 1, "A1", "Jo", None, "The “x”", None, "£6", "oil"), ("2", 2, "A1", "Al", None, "b", None, None, "ab"), ("3", 3, "B", "Cy", None, "c", None, None, None), ("4", 4, "B", "Di", None, "d", None, None, None), ("11", 6, "B", "Fy", None, "f", None, None, None)]
    policy = Reconcile(field_severity={"price": "high"})
    found = reconcile.reconcile(spark.createDataFrame(printed, kind), spark.createDataFrame(data, kind), policy=policy)
    got = [(r.kind, r.cat_no, r.field, r.severity, r.fix_channel) for r in reconcile.in_catalogue_order(found).collect()]
    assert got == [
        ("field_change", "1", "price", "high", "override"), ("field_change", "1", "title", "cosmetic", "override"), ("field_change", "2", "medium", "cosmetic", "override"), ("room_move", "3", None, "high", "spreadsheet"),
        ("entry_removed", "10", None, "high", "spreadsheet"), ("entry_added", "11", None, "high", "spreadsheet"), ("section_rename", None, None, "info", "spreadsheet"),
    ]
    assert reconcile.coverage(spark.createDataFrame(printed[:1], kind), spark.createDataFrame(data, kind)).first().suspicious


def test_round_trip_has_no_findings(spark):
    rows = export.collected(works.normalise_works(view(spark, SF, "works")))
    lines = export.tagged_lines(rows).selectExpr("'d' AS document", "section_position * 10000000000L + least(position, 9999999999L) AS ord", "explode(array(line)) AS paragraph")
    assert reconcile.reconcile(tags.parsed_entries(tags.styles_of(lines)), reconcile.display_fields(rows)).count() == 0


SPLITS = [
    (("Adam Caruso RA", "and Peter St John", None), ("Adam", "Caruso", "RA", "Peter St", "John", None)),
    (("Lucy Orta OBE RA", "& Jorge Orta cbe", "FRSA"), ("Lucy", "Orta", "OBE RA FRSA", "Jorge", "Orta", "cbe")),
    (("Ann RA Smith", "and Bo", ""), ("Ann", "Smith", "RA", None, "Bo", None)),
    (("Cher", "AND Sonny Bono", None), (None, "Cher", None, "Sonny", "Bono", None)),
]


def test_two_artists(spark):
    def split(*given):
        row = spark.createDataFrame([given], "a string, b string, c string").select(artists.two_artists(F.col("a"), F.col("b"), F.col("c")).alias("x")).first().x
        return None if row is None else tuple(row)

    for given, expected in SPLITS:
        assert split(*given) == expected
    assert split("Ann", "Anderson", None) is None and split(None, "and Bo", None) is None and split("RA", "and Bo", None) is None
    assert split("OBE Adam RA, Caruso CBE RA", "& frank RAYNER kc", " ") == ("Adam ,", "Caruso", "RA OBE CBE RA", "frank", "RAYNER", "kc")
    assert split("ÉRA Bé", "AND  RA", "x") == ("ÉRA", "Bé", "x", None, None, "RA")


INDEX = "row_number long, raw_title string, raw_first_name string, raw_last_name string, raw_quals string, raw_company string, raw_address string, cat_nos string, include_in_export boolean"


def test_index_lines(spark):
    rows = [(1, None, "Roger", "Adams", None, None, None, "3;1", True), (2, None, "Cornelia", "Parker", "CBE RA", None, None, "7", True), (3, "Sir", "Adam Caruso RA", "and Peter St John", None, None, None, "9", True), (4, None, None, "51 <Architects>", None, None, None, "2", True), (5, None, "Lucy", "Orta", None, "Studio", None, "4", True)]
    edits = spark.createDataFrame([(5, "Jorge", "Orta", True)], "row_number long, artist2_first_name_override string, artist2_last_name_override string, artist2_shared_surname_override boolean")
    none = spark.createDataFrame([], "match_first_name string, match_last_name string, match_quals string, is_seeded boolean, rule_id long")
    df = spark.createDataFrame(rows, INDEX)
    resolved = artists.resolved_artists(artists.parsed_rows(df), none, edits)
    numbers = df.selectExpr("row_number", "raw_address AS courtesy", "explode(transform(split(cat_nos, ';'), x -> int(x))) AS cat_no")
    layout = IndexLayout(letter_headings=True, style_digits=True, section_separator="none", number_style="", quals_style="q", member_quals_style="r", member_surname_style="M", digits_style="D")
    lines = artists.index_lines(artists.index_entries(resolved, numbers), layout)
    assert [r.line for r in lines.orderBy(F.col("letter") != "#", "letter", "place", "sort_key").collect()] == [
        "<ASCII-MAC>", "<pstyle:Index Text>#", "<pstyle:Index Text><cstyle:D>51<cstyle:> \\<Architects\\>, 2", "<pstyle:Index Text>A", "<pstyle:Index Text>Adams, Roger, 1, 3",
        "<pstyle:Index Text>C", "<pstyle:Index Text><cstyle:M>Caruso<cstyle:>, Sir Adam <cstyle:r>ra<cstyle:>, and Peter St John, 9", "<pstyle:Index Text>O", "<pstyle:Index Text>Orta, Lucy and Jorge, Studio, 4",
        "<pstyle:Index Text>P", "<pstyle:Index Text><cstyle:M>Parker<cstyle:>, Cornelia <cstyle:r>cbe ra<cstyle:>, 7",
    ]
    names = {r.row_number: r.index_name for r in resolved.collect()}
    assert names[3] == "Caruso, Sir Adam RA, and Peter St John" and names[5] == "Orta, Lucy and Jorge" and names[4] == "51 <Architects>"


def test_layers(spark):
    df = artists.parsed_rows(spark.createDataFrame([(1, None, "A", "B", "RA", None, None, "1", True), (2, None, "A", "B", None, None, None, "1", True)], INDEX))
    known = spark.createDataFrame([("A", "B", "", "", None, True, 1), ("A", "B", "", "seed", None, True, 2), ("A", "B", "", "user", "Co", False, 3), ("A", "B", "RA", None, None, True, 4)], "match_first_name string, match_last_name string, match_quals string, resolved_first_name string, resolved_last_name string, is_seeded boolean, rule_id long")
    edits = spark.createDataFrame([(2, "", True)], "row_number long, first_name_override string, is_company_override boolean")
    got = {r.row_number: (r.first_name, r.last_name, r.is_company, r.company, r.index_name) for r in artists.resolved_artists(df, known, edits).collect()}
    assert got == {1: ("A", "B", False, None, "B, A RA"), 2: (None, "Co", True, "Co", "Co")}


@pytest.mark.parametrize("stretch", [1, 3, 65_536])
def test_numbered(spark, monkeypatch, stretch):
    monkeypatch.setattr(ordering, "STRETCH", stretch)
    rows = [(i * 2, None if i % 3 == 0 else i % 3) for i in range(40)]
    got = {r.ord: r["rank"] for r in ordering.numbered(spark.createDataFrame(rows, "ord long, k int"), ["k"]).collect()}
    place = {}
    for o, k in sorted(rows):
        place[k] = place.get(k, 0) + 1
        assert got[o] == place[k]


def test_artwork_and_title_case(spark):
    df = spark.createDataFrame([(1, 1, "1", "A", True, "THE SEA", "x", "oil", "5", None, " 12 "), (2, 2, "2", "A", True, "b", "y", None, None, None, "x")], "work_id long, ord long, cat_no string, gallery string, include_in_export boolean, raw_title string, raw_artist string, raw_medium string, raw_price string, raw_edition string, raw_artwork string")
    over = spark.createDataFrame([(2, "B cased", 7, None, None)], "work_id long, title_cased_override string, artwork_override int, price_text_override string, price_numeric_override decimal(12,2)")
    rows = export.collected(works.effective_works(works.with_title_case(works.normalise_works(df)), over)).orderBy("ord").collect()
    assert [(r.title_cased, r.artwork) for r in rows] == [("The Sea", 12), ("B cased", 7)]


def test_causes(spark):
    kind = "work_id long, ord long, cat_no string, gallery string, include_in_export boolean, raw_title string, raw_artist string, raw_medium string, raw_price string, raw_edition string"
    old = spark.createDataFrame([(1, 1, "1", "A", True, "a", "x", "oil", "5", None), (2, 2, "2", "A", True, "b", "y", "oil", "5", None)], kind)
    new = spark.createDataFrame([(11, 1, "1", "A", True, "a", "x", "oil", "6", None), (12, 2, "2", "B", True, "b2", "y", "oil", "5", None)], kind)
    over = "work_id long, title_override string, artist_name_override string, artist_honorifics_override string, price_text_override string, price_numeric_override decimal(12,2), edition_total_override int, medium_override string"
    before = spark.createDataFrame([(1, None, None, None, None, None, None, "ink")], over)
    after = spark.createDataFrame([(12, "c", None, None, None, None, None, None)], over)
    got = {(r.old_ord, r.field): r.cause for r in match.effective_diff(works.normalise_works(old), before, works.normalise_works(new), after).collect()}
    assert got == {(1, "price_numeric"): "source", (1, "price_text"): "source", (1, "medium"): "override", (2, "title"): "override+source", (2, "section"): "source"}


def test_snapshots(spark):
    at = lambda d: F.lit(f"2025-01-0{d}").cast("timestamp_ntz")
    state = lambda x: spark.createDataFrame([(x,)], "v string")
    rows = reimport.snapshot_rows(state("a"), "i", None, at(1)).union(reimport.snapshot_rows(state("b"), "i", None, at(2))).union(reimport.snapshot_rows(state("c"), "i", "t", at(1)))
    assert sorted(r.row.v for r in reimport.latest_snapshots(rows).collect()) == ["b", "c"]
    back, before = reimport.restored(state("now"), rows, "i", at(3))
    assert [r.v for r in back.collect()] == ["b"] and before.first().template == "pre_restore" and before.first().row.v == "now"


def test_template_export(spark):
    rows = [(1, 'A "b" é!', False, None, '{"x": [1, {"y": null}]}'), (2, None, False, "s", None), (3, "gone", True, "g", "{}"), (4, "c", False, "", " { } ")]
    got = {r.template_id: (r.file_name, json.loads(r.json)) for r in report.template_export(spark.createDataFrame(rows, "template_id int, name string, archived boolean, slug string, config string")).collect()}
    assert got == {1: ("a-b.json", {"_name": 'A "b" é!', "x": [1, {"y": None}]}), 2: ("s.json", {"_name": None}), 4: ("c.json", {"_name": "c"})}


def test_lines_without_sql(spark):
    """Queries that SQL can't express give rows whose parts agree with other queries."""
    wrapped, plain = QUERIES["export_wrapped"](spark, SF), QUERIES["export_tagged"](spark, SF)
    assert wrapped.count() == plain.count()
    lines, headed = QUERIES["index_lines"](spark, SF), QUERIES["index_lines_with_headings"](spark, SF)
    entries = lines.where("place = 1").count()
    assert entries and headed.where("place = 1").count() == entries and headed.where("place = 0 and letter is not null").count() == lines.where("letter is not null").select("letter").distinct().count() == headed.where("place = -1").count() + 1
    changed = QUERIES["index_diff"](spark, SF).collect()
    assert changed and {r.kind for r in changed} <= {"added", "removed", "changed"}
    assert {r.cause for r in QUERIES["effective_diff"](spark, SF).collect()} >= {"source", "override"}
    assert QUERIES["index_listing"](spark, SF).count() == QUERIES["index_parsed"](spark, SF).count()


def workbook(rows):
    """A workbook with one sheet of inline strings."""
    import io
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda r, c, v: "" if v is None else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_headers(spark, tmp_path):
    good, bad = tmp_path / "good.xlsx", tmp_path / "bad.xlsx"
    good.write_bytes(workbook([["Cat No", "Title", "Artist", "Note"], ["1", "t", "a", None], [None, None, None, "only a note"]]))
    bad.write_bytes(workbook([["Cat No", "Titel"], ["1", "t"]]))
    expected = {"Cat No": True, "Title": True, "Artist": True, "Price": False}
    found = {(r.path.rsplit("/", 1)[1], r.type, r.message) for r in header_report(spark, str(tmp_path), expected).collect()}
    assert found == {("good.xlsx", "missing_column", "Price"), ("bad.xlsx", "missing_required", "Title (is it Titel?)"), ("bad.xlsx", "missing_required", "Artist"), ("bad.xlsx", "missing_column", "Price")}
    assert read_workbooks(spark, str(good), True, expected).count() == 1 and read_workbooks(spark, str(good), False, expected).count() == 2
    with pytest.raises(Exception, match="Title"):
        read_workbooks(spark, str(bad), True, expected).count()

"""Catalogue operators on literal rows, and every SQL-expressible query against DuckDB on the smallest tables."""

import unicodedata

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.config import Catalogue, Normalisation
from quire.functions import text as T
from quire.functions.titles import title_case_text
from quire.functions.unicode import sort_key, title_case
from quire.operators import compare, index, match, works
from quire.plans.queries import ORACLES, QUERIES
from quire.sources.views import with_views

SF = "/root/testdata/sf0.001"


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_artist_name(spark):
    got = column(spark, ["Jane Doe RA", "  Jane  Doe ", "RA", "HON RA", "", None, "A B hon ra elect"], T.artist_name)
    assert [tuple(x) for x in got] == [("Jane Doe", "RA"), ("Jane  Doe", None), ("RA", None), ("", "HON RA"), (None, None), (None, None), ("A B", "hon ra elect")]


def test_price(spark):
    got = column(spark, ["£1,234.99", "nfs", "*", "", None, "1.2.3", ".", "POA 2024", " POA "], T.price)
    assert [(None if x.numeric is None else int(x.numeric), x.text) for x in got] == [(1234, "1234"), (None, "NFS"), (None, "*"), (None, "*"), (None, "*"), (None, "1.2.3"), (None, "."), (2024, "2024"), (None, "POA")]


def test_edition(spark):
    got = column(spark, ["Edition of 7 at £920", "Edition of 5", "Edition of 0", "edition of 3", None, "Edition of 3 at ,", "Edition of 2 at £1,200.50"], T.edition)
    assert [(x.total, None if x.price is None else int(x.price)) for x in got] == [(7, 920), (5, None), (None, None), (None, None), (None, None), (3, None), (2, 1200)]


def test_members_and_numbers(spark):
    assert column(spark, ["FRSA", "cbe ra", "Hon RA", None], T.is_member) == [False, True, True, False]
    assert column(spark, ["1; 2,x, 3 ;;1", None, ""], T.catalogue_numbers) == [[1, 2, 3, 1], None, []]


def test_fingerprint(spark):
    got = column(spark, ["  COLD  DARK MATTER  ", "Cold Dark Matter", None], lambda c: T.fingerprint(c, c, c))
    assert got[0] == got[1] and tuple(got[2]) == ("", "", "")


TITLES = [
    ("WHAT DO ANIMALS DREAM OF?", "What Do Animals Dream Of?"), ("THE POSSIBILITY OF AN ISLAND", "The Possibility of an Island"), ("UNTITLED VIII", "Untitled VIII"), ("STUDY XIV", "Study XIV"), ("THE MIX", "The Mix"),
    ("PORTRAIT FOR THE USA", "Portrait for the USA"), ("HOMAGE TO RA", "Homage to RA"), ("the iPhone diaries", "The iPhone Diaries"), ("", ""), (" ", " "),
    ("word/word", "Word/Word"), ("dance with me/let’s face the music and dance", "Dance With Me/Let’s Face the Music and Dance"), ("X-RAY OF A HAND", "X-Ray of a Hand"), ("mccay-mcbut-mcdo mcdonalds/mcby", "McCay-McBut-McDo McDonalds/McBy"),
    ("34th 3rd 2nd", "34th 3rd 2nd"), ("FOO BAR 5TH ST", "Foo Bar 5th St"), ("Q&A with steve jones: 'that's what happens'", "Q&A With Steve Jones: 'That's What Happens'"), ("this v. that vs them", "This v. That vs Them"),
    ("'by the Way, small word at the start but within quotes.'", "'By the Way, Small Word at the Start but Within Quotes.'"), ("nothing to be afraid of", "Nothing to Be Afraid Of"), ('"nothing to be afraid of?"', '"Nothing to Be Afraid Of?"'),
    ("Starting a phrase with a small word: a trick, perhaps?", "Starting a Phrase With a Small Word: A Trick, Perhaps?"), ("one - the other", "One - The Other"), ("a thing", "A Thing"), ("2lmc spool: 'gruber on OmniFocus and vapo(u)rware'", "2lmc Spool: 'Gruber on OmniFocus and Vapo(u)rware'"),
    ("this is just an example.com", "This Is Just an example.com"), ("listed on del.icio.us", "Listed on del.icio.us"), ("this is http://foo.com", "This Is http://foo.com"), ("WASHINGTON, D.C. SHOULD BE FIXED", "Washington, D.C. Should Be Fixed"),
    ("my name is o'reilly", "My Name Is O'Reilly"), ("l'grange L'grange d'artagnan", "l'Grange l'Grange d'Artagnan"), ("mr McTavish went to mcdonald's", "Mr McTavish Went to McDonald's"), ("this shouldn't\r\nget mangled", "This Shouldn't\nGet Mangled"),
    ("the\ttab  two", "The\tTab  Two"), ("THE NTH RHYTHM OF BBC", "The NTH Rhythm of BBC"), ("«the» ÉTUDE", "«the» ÉTUDE"),
]


def test_titles(spark):
    for given, expected in TITLES:
        assert title_case_text(given) == expected
    assert title_case_text("MADE IN THE ACME WORKSHOP", ["ACME"]) == "Made in the ACME Workshop" and title_case_text("bbc", []) == "BBC" and title_case_text("USA", []) == "Usa"
    df = spark.createDataFrame([(t,) for t, _ in TITLES] + [(None,)], "t string").select(title_case("t").alias("t"))
    assert [r.t for r in df.collect()] == [e for _, e in TITLES] + [None]


def test_title_case():
    assert title_case_text("the LORD OF the rings") == "The LORD of the Rings"
    assert title_case_text("HENRY IV IN THE UK") == "Henry IV in the UK"
    assert title_case_text("a day at moma: the end") == "A Day at MoMA: The End"


def test_sort_names(spark):
    rows = [(0, "Zo\u00eb", "d'\u00c9lan"), (1, "Assemble", None), (2, "Assemble", ""), (3, None, " Boyd & Evans "), (4, None, None), (5, "Ann Mary", "Van Dyck")]
    df = spark.createDataFrame(rows, "i int, first_name string, last_name string")
    got = [r.k for r in df.withColumn("k", sort_key(index.sort_name(df))).orderBy("i").collect()]
    assert got == ["d'elan zoe", "assemble", "assemble", "boyd & evans", "", "van dyck ann mary"]


def test_whole_sort_keys(spark, duck):
    sql = with_views("SELECT artist_id, strip_accents(lower(trim(concat(coalesce(nullif(last_name, ''), first_name, ''), ' ', CASE WHEN coalesce(last_name, '') <> '' THEN coalesce(first_name, '') ELSE '' END)))) AS sort_key FROM index_artists", "index_artists")
    assert rows_of(QUERIES["artist_sort_keys"](spark, SF).toPandas()) == rows_of(duck.execute(sql).df())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    keys = {r.doc_id: r.sort_key for r in QUERIES["document_sort_keys"](spark, SF).collect()}
    plain = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t.strip().lower()) if not unicodedata.combining(x))
    assert keys == {i: None if t is None else plain(t) for i, t in texts.items()} and any(" " in k for k in keys.values())


#: Title, artist, price, edition, medium; the warnings with editions up to 1 suppressed.
WARNED = [
    (("Henry IV", "Jane Doe", "10", None, "oil"), ["title_case_roman"]),
    (("(xiv), by night", "Jane Doe", "10", None, "oil"), ["title_case_roman"]),
    (("MMMM", "Jane Doe", "10", None, "oil"), ["title_case_roman"]),
    (("Mix of I", "Jane Doe", "10", None, "oil"), []),
    (("La mer at MoMA", "Jane Doe", "10", None, "oil"), ["title_case_exception"]),
    (("UK II", "Jane Doe", "10", None, "oil"), ["title_case_exception", "title_case_roman"]),
    (("a", "Jane Doe", None, "Edition of 1 at £500", "oil"), ["edition_suppressed_no_price", "missing_price"]),
    (("a", "Jane Doe", "10", "Edition of 1 at £500", "oil"), ["edition_suppressed"]),
    (("a", "Jane Doe", "NFS", "Edition of 1 at £500", "oil"), ["edition_suppressed"]),
    (("a", "Jane Doe", "*", "Edition of 1", "oil"), ["edition_suppressed", "missing_price"]),
    ((None, "Jane Doe ÉLU", "10", "Edition of 0 at £5", "oil"), ["missing_title", "non_ascii_characters", "zero_edition_suppressed"]),
]


def test_warnings(spark):
    settings = Catalogue(Normalisation(honorific_tokens=("RA", "ÉLU"), edition_suppress_max=1))
    df = spark.createDataFrame([(i, *w) for i, (w, _) in enumerate(WARNED)], "work_id int, raw_title string, raw_artist string, raw_price string, raw_edition string, raw_medium string")
    got = works.warnings(works.normalise_works(df, settings), settings).collect()
    assert [sorted(r.type for r in got if r.work_id == i) for i in range(len(WARNED))] == [x for _, x in WARNED]


def test_all_work_warnings(spark):
    got = {n: {(r.work_id, r.type) for r in QUERIES[n](spark, SF).collect()} for n in ("all_work_warnings", "work_warnings")}
    assert got["work_warnings"] == got["all_work_warnings"]
    roman = {r.work_id for r in QUERIES["normalise_works"](spark, SF).where("title like '% IV'").collect()}
    assert roman and {(i, "title_case_roman") for i in roman} <= got["work_warnings"]
    counts = {r.type: r.n for r in QUERIES["all_warning_counts"](spark, SF).collect()}
    assert counts["title_case_roman"] == len(roman) and sum(counts.values()) == len(got["all_work_warnings"])


NAMES = [
    (("Roger Adams", None, None, "Roger", "Adams", None), ("exact", [])),
    (("Ryan Gander", "RA", None, "Ryan", "Gander", "OBE RA"), ("partial_honorific", ["extra_quals_in_index:obe"])),
    (("Alice Smith", None, None, "Bob", "Jones", None), ("none", ["last_name_different", "first_name_different"])),
    (("Alice Smith", None, None, "Bob", "Smith", None), ("partial_name", ["first_name_different"])),
    (("Alice Smith", None, "Dr", "Bob", "Smith", None), ("partial_title", ["title_in_index_not_in_low"])),
    (("Jane Doe", "RA", None, "Jane", "Doe", None), ("partial_ra", ["extra_ra_in_low:ra"])),
    (("Doe Jane", None, None, "Jane", "Doe", None), ("equivalent", ["last_name_different", "first_name_different"])),
]


def test_name_comparison(spark):
    df = spark.createDataFrame([(i, *n, False) for i, (n, _) in enumerate(NAMES)], "i int, name string, honorifics string, title string, first string, last string, quals string, is_company boolean")
    got = [(r.level, r.differences) for r in compare.compare_names(df).orderBy("i").collect()]
    assert got == [x for _, x in NAMES]


def plain_plan(old, new):
    """The match plan by a loop."""
    first, free, used, plan = {}, {}, set(), {}
    for n in new:
        if n[1]:
            first.setdefault(n[1], n)
    for o in old:
        f = first.get(o[1]) if o[1] else None
        if f and f[2] == o[2]:
            plan[o[0]] = ("cat_no", f[0])
            used.add(f[0])
    claimed = set(used)
    for o in old:
        if o[0] in plan:
            continue
        same = [n for n in new if n[2] == o[2] and n[0] not in used]
        left = [n for n in same if n[0] not in claimed]
        if len(left) == 1 and len(same) == 1:
            plan[o[0]] = ("fingerprint", left[0][0])
            claimed.add(left[0][0])
        elif len(left) > 1:
            plan[o[0]] = ("fingerprint_collision", None)
        else:
            f = first.get(o[1]) if o[1] else None
            plan[o[0]] = ("cat_no_match_fingerprint_mismatch", f[0]) if f and f[0] not in claimed else ("no_fingerprint_match", None)
    return plan


def test_match_plan(spark):
    import random

    rng = random.Random(5)
    for _ in range(3):
        rows = [[(i, rng.choice(["1", "2", "3", "4", None]), rng.choice("abcd")) for i in range(12)] for _ in range(2)]
        frames = [spark.createDataFrame([(i, c, t, "x", "y") for i, c, t in r], "ord long, cat_no string, raw_title string, raw_artist string, raw_medium string") for r in rows]
        got = {r.old_ord: (r.outcome, r.new_ord) for r in match.match_plan(*frames).collect()}
        assert got == plain_plan(*rows)


def test_match_of_unicode_variants(spark):
    kinds = "ord long, cat_no string, gallery string, include_in_export boolean, raw_title string, raw_artist string, raw_medium string, raw_price string, raw_edition string"
    old = [(1, "1", "A", True, "Caf\u00e9", "Zo\u00eb", "oil", None, None), (2, "2", "A", True, "Full width", "\ufb01sh", "oil", None, None), (3, "3", "A", True, None, "x", None, None, None)]
    new = [(11, "8", "A", True, "Cafe\u0301", "Zoe\u0308", "oil", None, None), (12, "2", "B", True, "\uff26\uff55\uff4c\uff4c\u3000width", "fish", "oil", None, None), (13, "3", "A", True, "", "X", "", None, None)]
    a, b = spark.createDataFrame(old, kinds), spark.createDataFrame(new, kinds)
    got = {r.old_ord: (r.outcome, r.new_ord) for r in match.match_plan(a, b).collect()}
    assert got == {1: ("fingerprint", 11), 2: ("cat_no", 12), 3: ("cat_no", 13)}
    assert {tuple(r) for r in match.state_pairs(a, b).collect()} == {(1, 11), (2, 12), (3, 13)}
    assert [tuple(r) for r in match.cross_gallery_moves(a, b).collect()] == [(12, "A", "B")]
    assert not {"added", "removed"} & {r.field for r in match.state_diff(works.normalise_works(a), works.normalise_works(b)).collect()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "supplier", "customer", "nation", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(frame):
    clean = lambda v: None if pd.isna(v) else str(v) if not isinstance(v, float) else (str(int(v)) if v.is_integer() else repr(v))
    return sorted(repr([clean(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(ORACLES[name]).df())


def test_stream(spark, tmp_path):
    from quire.streaming.audit import latest_by_key

    events = spark.read.parquet(f"{SF}/events.parquet")
    source = tmp_path / "events"
    events.repartition(3).write.parquet(str(source))
    query = latest_by_key(spark.readStream.schema(events.schema).parquet(str(source))).writeStream.format("memory").queryName("latest").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("latest").collect()) == sorted(latest_by_key(events).collect())

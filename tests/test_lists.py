"""Lists that are imported again: what moves over, what is found anew, and that an import is there as a whole or not at all."""

from datetime import datetime

import pytest

from quire.operators.match import match_plan
from quire.operators.relisting import relisted_rows, relisting_counts
from quire.sources.lists import ListStore

SCHEMA = "ord long, cat_no string, gallery string, raw_title string, raw_artist string, raw_price string, raw_edition string, raw_medium string, include_in_export boolean, kind string"


def a_list(spark, *rows):
    """(number, gallery, title, included) as a list; the column ``kind`` clashes with the operator's and is of no account."""
    return spark.createDataFrame([(i, number, gallery, title, "Jo Doe RA", "10", None, "Oil", shown, "x") for i, (number, gallery, title, shown) in enumerate(rows)], SCHEMA)


FIRST = (("1", "A", "One", True), ("2", "A", "Two", False), (None, "", "Loose", True), ("4", "B", "Four", True), ("5", "B", "  Five ", True), ("6", "C", "Six", True))
#: One is renumbered, two has other content, B's works change places, one of them is gone, and two rows are new.
SECOND = (("9", "A", "One", True), ("2", "A", "Two and more", True), ("5", "B", "  Five ", True), ("7", "B", None, True), ("8", "D", "Eight", True), ("6", "C", "Six", False))
DAYS = [datetime(2025, 1, d) for d in range(1, 9)]


@pytest.fixture
def store(spark, tmp_path):
    store = ListStore(spark, str(tmp_path / "lists"))
    store.reimport(a_list(spark, *FIRST), "x", DAYS[0], "first.xlsx", headers=["Edition"])
    ids = {r.raw_title: r.work_id for r in store.works("x").collect()}
    edits = [(ids["One"], "Uno", "POA"), (ids["Two"], "Due", None), (ids["Six"], None, ""), ("gone", "x", "y")]
    store.override(spark.createDataFrame(edits, "work_id string, title_override string, price_text_override string"), "x", DAYS[1])
    return store


def listed(store):
    return [(r.gallery, r.section_position, r.position, r.cat_no, r.raw_title, r.include_in_export, r.origin) for r in store.works("x").orderBy("ord").collect()]


def test_first_import(spark, store):
    assert listed(store) == [
        ("A", 1, 1, "1", "One", True, "added"), ("A", 1, 2, "2", "Two", False, "added"), ("Uncategorised", 2, 1, None, "Loose", True, "added"),
        ("B", 3, 1, "4", "Four", True, "added"), ("B", 3, 2, "5", "  Five ", True, "added"), ("C", 4, 1, "6", "Six", True, "added"),
    ]
    found = sorted((r.work_id is None, r.type, r.message) for r in store.warnings("x").collect())
    assert found == [(False, "whitespace_trimmed", "White space trimmed from title"), (True, "missing_column", "Edition")]
    got = {r.raw_title: (r.title, r.artist_name, r.price_text, r.price_numeric and int(r.price_numeric)) for r in store.effective("x").collect()}
    assert got["One"] == ("Uno", "Jo Doe", "POA", None) and got["Two"] == ("Due", "Jo Doe", "10", 10) and got["Six"] == ("Six", "Jo Doe", "", 10) and got["  Five "][0] == "Five"


def test_whole_reimport(spark, store):
    before = {r.work_id: r.raw_title for r in store.works("x").collect()}
    store.reimport(a_list(spark, *SECOND), "x", DAYS[2], "second.xlsx")
    assert listed(store) == [
        ("A", 1, 1, "9", "One", True, "matched"), ("A", 1, 2, "2", "Two and more", True, "added"), ("B", 2, 1, "5", "  Five ", True, "matched"),
        ("B", 2, 2, "7", None, True, "added"), ("D", 3, 1, "8", "Eight", True, "added"), ("C", 4, 1, "6", "Six", True, "matched"),
    ]
    titles = {r.work_id: r.raw_title for r in store.works("x").collect()}
    assert not set(titles) & set(before)  # rebuilt works are new works
    assert {titles[r.work_id]: (r.title_override, r.price_text_override) for r in store.overrides("x").collect()} == {"One": ("Uno", "POA"), "Six": (None, "")}
    assert {(titles.get(r.work_id), r.type) for r in store.warnings("x").collect()} == {("  Five ", "whitespace_trimmed"), (None, "missing_title")}  # the row without a title; no header's
    outcomes = {r.raw_title: (r.outcome, r.override is not None) for r in store.before("x").collect()}
    assert outcomes == {"One": ("fingerprint", True), "Two": ("cat_no_match_fingerprint_mismatch", True), "Loose": ("no_fingerprint_match", False), "Four": ("no_fingerprint_match", False), "  Five ": ("cat_no", False), "Six": ("cat_no", True)}
    last = [tuple(r)[1:] for r in store.audit("x").orderBy("at").collect()][-1]
    assert last == (DAYS[2], "reimport", "second.xlsx", "matched=3, added=3, removed=3, overrides_preserved=2, matched_by_cat_no=2, matched_by_fingerprint=1, overrides_at_risk=1")


def test_reimport_of_some_galleries(spark, store):
    kept = {r.raw_title: r.work_id for r in store.works("x").collect()}
    assert {(r.outcome, r.new_ord) for r in store.plan(a_list(spark, *SECOND), "x", ["B", "D"]).collect()} == {("no_fingerprint_match", None), ("cat_no", 2)}
    for _ in range(2):  # repeated after a lost driver
        store.reimport(a_list(spark, *SECOND), "x", DAYS[2], None, ["D", "B"])
    assert listed(store) == [
        ("A", 1, 1, "1", "One", True, "kept"), ("A", 1, 2, "2", "Two", False, "kept"), ("Uncategorised", 2, 1, None, "Loose", True, "kept"),
        ("B", 3, 1, "5", "  Five ", True, "matched"), ("B", 3, 2, "7", None, True, "added"), ("C", 4, 1, "6", "Six", True, "kept"), ("D", 5, 1, "8", "Eight", True, "added"),
    ]
    now = {r.raw_title: r.work_id for r in store.works("x").collect()}
    assert {t for t in now if now[t] == kept.get(t)} == {"One", "Two", "Loose", "Six"}
    assert store.overrides("x").count() == 3
    assert sorted((r.work_id is None, r.type) for r in store.warnings("x").collect()) == [(False, "missing_title"), (False, "whitespace_trimmed"), (True, "missing_column")]
    assert store.before("x").where("outcome is null").count() == 4 and store.before("x").count() == 6
    assert store.audit("x").count() == 3
    assert store.audit("x").orderBy("at").collect()[-1].new_value.endswith("overrides_at_risk=0, scope=['B', 'D']")


def test_empty_lists(spark, store):
    store.reimport(a_list(spark).limit(0), "x", DAYS[2], headers=["Cat No"])
    assert listed(store) == [] and store.overrides("x").count() == 0 and store.before("x").count() == 6
    assert {(r.work_id, r.type) for r in store.warnings("x").collect()} == {(None, "missing_column"), (None, "empty_spreadsheet")}
    assert store.works("other").count() == 0 == store.audit("other").count()
    store.reimport(a_list(spark, *FIRST), "other", DAYS[3])
    assert store.works("other").count() == 6 and listed(store) == []


def test_a_lost_reimport_leaves_nothing(spark, store, monkeypatch):
    from quire.sources import store as module

    seen, write = listed(store), module._write
    monkeypatch.setattr(module, "_write", lambda df, path, *keys: (_ for _ in ()).throw(OSError("lost")) if path.endswith("manifest") else write(df, path, *keys))
    with pytest.raises(OSError):
        store.reimport(a_list(spark, *SECOND), "x", DAYS[2])
    monkeypatch.undo()
    assert listed(store) == seen and store.audit("x").count() == 2 and store.before("x").count() == 0


def test_repeated_rows_and_nulls(spark):
    """Equal rows pair once; rows of nulls are works like others; warnings are found anew where none are given."""
    old = a_list(spark, ("1", "A", "Same", True), ("1", "A", "Same", True), (None, None, None, None)).selectExpr("*", "ord * 10 as work_id")
    new = a_list(spark, ("1", "A", "Same", False), (None, None, None, True), (None, None, None, True))
    overrides = spark.createDataFrame([(0, "x"), (20, "y")], "work_id long, title_override string")
    rows = relisted_rows(old, new, overrides).persist()
    assert rows.groupBy("kind").count().orderBy("kind").collect() == [("before", 3), ("work", 3)]
    got = relisting_counts(rows).first().asDict()
    # Both of the equal rows go with the one new row, which takes over from the last; nulls are equal, but two free rows are one too many.
    assert got == {"matched": 2, "added": 2, "removed": 1, "overrides_preserved": 1, "matched_by_cat_no": 2, "matched_by_fingerprint": 0, "overrides_at_risk": 1}
    assert [(r.from_work, r.override) for r in rows.where("origin = 'matched'").collect()] == [("10", None)]
    assert {r.type for r in rows.where("kind = 'work' and source.cat_no is null").selectExpr("inline(warnings)").collect()} == {"missing_title"}
    rows.unpersist()


def test_the_plan_is_made_once(spark):
    """What a re-import writes needs the fingerprints as often as the match plan alone, and no join of all pairs."""
    old, new = a_list(spark, *FIRST).selectExpr("*", "ord as work_id"), a_list(spark, *SECOND)
    overrides = spark.createDataFrame([], "work_id long, title_override string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        texts = [df._jdf.queryExecution().executedPlan().toString() for df in (relisted_rows(old, new, overrides, galleries=["A"]), match_plan(old, new))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert texts[0].count("ArrowEvalPython") == texts[1].count("ArrowEvalPython") > 0
    assert "CartesianProduct" not in texts[0] and "BroadcastNestedLoopJoin" not in texts[0]


def test_audit_of_index_edits(spark):
    from quire.operators.reimport import edit_audit, toggle_audit

    schema = "row_number long, first_name_override string, is_company_override boolean"
    before = spark.createDataFrame([(1, "a", None), (2, "b", True), (3, "c", True), (4, None, None)], schema)
    after = spark.createDataFrame([(1, "a", None), (2, "", None), (5, "n", False), (6, None, None)], schema)
    assert sorted(map(tuple, edit_audit(before, after).collect()), key=str) == [
        (2, "override_set", "first_name_override", "b", ""), (2, "override_set", "is_company_override", "True", None), (3, "override_deleted", None, None, None), (4, "override_deleted", None, None, None),
        (5, "override_set", "first_name_override", None, "n"), (5, "override_set", "is_company_override", None, "False"),
    ]
    artists = spark.createDataFrame([(1, True, False), (2, True, True), (3, None, None)], "row_number long, include_in_export boolean, is_company boolean")
    toggles = spark.createDataFrame([(1, True, True), (2, False, False), (3, False, True), (4, True, True)], "row_number long, exclude boolean, is_company boolean")
    got = sorted(map(tuple, toggle_audit(artists, before, toggles).collect()), key=str)
    assert got == [
        (1, "index_artist_company_set", "is_company_override", "False", "True"), (1, "index_artist_excluded", "include_in_export", "True", "False"),
        (2, "index_artist_company_unset", "is_company_override", "True", "False"), (3, "index_artist_included", "include_in_export", "False", "True"),
    ]
    assert edit_audit(before.limit(0), after.limit(0)).count() == 0 == toggle_audit(artists, before, toggles.limit(0)).count()


def test_templates_from_files(spark):
    from quire.operators.report import template_import

    rows = [("a/t1.json", '{"_name": "Li\\"st", "x": {"_name": 1}, "y": [1, 2]}\n'), ("b.json", '{"_name":null}'), ("c", '{ "z": null }'), ("d.json", "not JSON"), ("e.json", ""), ("f.json", None)]
    got = [tuple(r) for r in template_import(spark.createDataFrame(rows, "path string, value string")).orderBy("slug").collect()]
    assert got == [("b", "b", "{}"), ("c", "c", '{ "z": null }'), ("d", "d", None), ("e", "e", None), ("f", "f", None), ("t1", 'Li"st', '{"x": {"_name": 1}, "y": [1, 2]}')]

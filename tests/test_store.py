"""Snapshots, imports, files and seeds: repeated writes, restores, pruning and deletions."""

import contextlib
import io
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quire.sources.store import FileStore, ImportTable, StateStore, seeded_table


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def explained(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_snapshots(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"), "id long, entry2 string")
    rows = spark.createDataFrame([(i, f"x{i}") for i in range(6)], "id long, entry2 string")
    assert store.latest("a").count() == 0 and store.snapshots().count() == 0
    store.save(rows.where("id < 3"), "a", None, datetime(2025, 1, 1))
    store.save(rows.where("id < 5"), "a", "t/ü", datetime(2025, 1, 2))
    store.save(rows.where("id < 5"), "a", "t/ü", datetime(2025, 1, 2))
    store.save(rows.where("id > 3"), "b", None, datetime(2025, 1, 3))
    assert store.snapshots("a").count() == 2 and store.log.rows().count() == 3 + 5 + 2
    assert [r[0] for r in values(store.latest("a"))] == [0, 1, 2]
    assert [r[0] for r in values(store.latest("a", "t/ü"))] == [0, 1, 2, 3, 4] == [r[0] for r in values(store.latest("a", any_template=True))]
    store.save(rows.where("id = 1"), "a", None, datetime(2025, 1, 1))  # the same snapshot again, with other rows
    assert values(store.latest("a")) == [(1, "x1")]
    current = rows.where("id = 5")
    for _ in range(2):
        back = store.restore(current, "a", datetime(2025, 1, 9))
        assert [r[0] for r in values(back)] == [0, 1, 2, 3, 4]
    assert values(store.latest("a", "pre_restore")) == [(5, "x5")] and store.snapshots("a").count() == 3


def test_rows_without_a_manifest_entry_stay_unseen(spark, tmp_path, monkeypatch):
    """A writer that dies between rows and entry leaves nothing behind that readers see."""
    from quire.sources import store as module

    store = StateStore(spark, str(tmp_path / "s"), "id long")
    rows = spark.range(4)
    store.save(rows.limit(1), "a", None, datetime(2025, 1, 1))
    write = module._write
    monkeypatch.setattr(module, "_write", lambda df, path, *keys: (_ for _ in ()).throw(OSError("lost")) if path.endswith("manifest") else write(df, path, *keys))
    with pytest.raises(OSError):
        store.save(rows, "a", None, datetime(2025, 1, 2))
    assert store.latest("a").count() == 1 and store.log.rows().count() == 1
    monkeypatch.undo()
    store.save(rows, "a", None, datetime(2025, 1, 2))
    assert store.latest("a").count() == 4 and store.log.rows().count() == 5


def test_imports_are_replaced_and_pruned(spark, tmp_path):
    table = ImportTable(spark, str(tmp_path / "i"), "work_id long")
    table.replace(spark.range(90).select(F.col("id").alias("work_id"), (F.col("id") % 9).cast("string").alias("import_id")))
    table.replace(spark.createDataFrame([(1000, "3")], "work_id long, import_id string"))
    assert values(table.rows("3")) == [(1000, "3")] and table.rows().count() == 81
    assert re.search(r"PartitionFilters: \[.*import_id.* IN \(3,4\)", explained(table.rows("3", "4")))
    wanted = spark.createDataFrame([("5", 7), ("6", 0), (None, 7)], "import_id string, n int").where("n > 5")
    found = table.rows_of(wanted)
    assert "dynamicpruning" in explained(found)
    assert {r.import_id for r in found.collect()} == {"5"}


def test_files(spark, tmp_path):
    store = FileStore(spark, str(tmp_path / "f"))
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, content binary")
    assert store.listing().count() == 0 and tuple(store.stats().first()) == (0, 0)
    store.save(files(("up/a.xlsx", b"one"), ("../../b.txt", b""), ("c\\d.txt", b"\xff\x00"), ("x/", b"no key")), "w1")
    store.save(files(("other/a.xlsx", b"newer")), "w2")
    store.save(files(("other/a.xlsx", b"newer")), "w2")
    paths = spark.createDataFrame([("a.xlsx",), ("z/b.txt",), ("d.txt",), ("none",)], "path string")
    assert {r.key: bytes(r.content) for r in store.load(paths).collect()} == {"a.xlsx": b"newer", "b.txt": b"", "d.txt": b"\xff\x00"}
    store.delete(paths.where("path = 'a.xlsx'"), "w3")
    assert {r.key: r.there for r in store.exists(paths).collect()} == {"a.xlsx": False, "b.txt": True, "d.txt": True, "none": False}
    assert {(r.key, r.size) for r in store.listing().collect()} == {("b.txt", 0), ("d.txt", 2)} and tuple(store.stats().first()) == (2, 2)
    store.save(files(("a.xlsx", b"back")), "w4")
    assert store.load(paths.where("path = 'a.xlsx'")).first().content == b"back"


def test_seeds(spark):
    schema = "first string, last string, value string, is_seeded boolean, extra int"
    current = spark.createDataFrame([("a", "b", "1", True, 1), ("a", "b", "mine", False, 2), ("c", None, "1", True, 3), ("gone", "x", "1", True, 4), ("u", "x", "1", None, 5)], schema)
    seeds = spark.createDataFrame([("a", "b", "1"), ("c", None, "2"), ("new", "n", None), ("new", "n", None)], "first string, last string, value string")
    got = {(r.first, r.last, r.value, r.is_seeded, r.extra, r.action) for r in seeded_table(current, seeds, ["first", "last"], ["value"]).collect()}
    assert got == {("a", "b", "1", True, 1, "keep"), ("a", "b", "mine", False, 2, "user"), ("c", None, "2", True, 3, "update"), ("u", "x", "1", None, 5, "user"), ("new", "n", None, True, None, "insert")}
    assert {r.action for r in seeded_table(current, seeds.limit(0), ["first", "last"], ["value"]).collect()} == {"user"}

"""The stages one after the other, each judged on its own input by a plain version where there is one."""

import re

import corpus_pipeline
from quire.llm.minhash_dedup import near_duplicates
from quire.llm.mixing import mix_sources
from quire.llm.queries import table
from quire.llm.quality import classify
from quire.llm.shared import Tables

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    tables, docs = Tables(spark), table(spark, SF, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        kept.append((name, docs))
        docs = tables.keep(stage(spark, docs, SF), name.replace(" ", "-"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    (_, start), (_, good), (_, apart), (_, cut), (_, mixed) = kept

    judged = {r.doc_id: r.kept for r in classify(start, table(spark, SF, "labels")).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, k in judged.items() if k}

    rows = {r.doc_id: r.text for r in good.collect()}
    stays = {r.doc_id for r in apart.collect()}
    assert stays == {r.doc_id for r in near_duplicates(good).where("kept").collect()}
    sets = {i: shingles(t) for i, t in rows.items()}
    for i in stays:
        for j in stays:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]):
                assert 100 * len(sets[i] & sets[j]) < 75 * len(sets[i] | sets[j])

    seen, expected = set(), {}
    for r in sorted(apart.collect(), key=lambda r: r.doc_id):
        w, gone = words(r.text), set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        if not gone or len(gone) < len(w):
            expected[r.doc_id] = r.text if not gone else " ".join(x for k, x in enumerate(w) if k not in gone)
    assert {r.doc_id: r.text for r in cut.collect()} == expected
    assert all(r.n_chars == len(r.text or "") for r in cut.collect())

    assert {r.doc_id for r in mixed.collect()} <= set(expected)
    assert all(n <= 3 for n in mixed.groupBy("doc_id").count().toPandas()["count"])
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in mixed.collect()}


def test_run_and_empty_input(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_clashing_columns_and_nulls(spark):
    """Extra columns with the operators' own names go through every stage but the last."""
    source = table(spark, SF, "documents").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, None, "en", None, None), (900_002, "", None, "web", 0)], source.schema)
    docs = source.union(odd).union(source.limit(3)).selectExpr("*", "1 AS rid", "'x' AS spans", "2 AS copies", "3 AS component_id", "4 AS kept", "5 AS id")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_mix_of_repeated_ids_and_long_texts(spark):
    """The mix takes what the operator says where ids repeat, with equal and other texts; very long texts pass."""
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (1, "d e f g", "en", "t", 7), (None, "h i", "en", "t", 3), (None, "h i", "en", "t", 3), (2, "w " * 30_000, "en", "s", 60_000)]
    docs = spark.createDataFrame(rows + [(10 + i, f"word{i} " * (i % 7 + 1), "en", "st"[i % 2], 9) for i in range(60)], table(spark, SF, "documents").schema)
    taken = sum(r.taken for r in mix_sources(docs).collect())
    out = corpus_pipeline.mix(spark, docs, SF)
    assert out.columns == docs.columns and sum(len(words(r.text)) for r in out.collect()) == taken
    apart = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r.text for r in apart if r.doc_id == 1) == ["a b c", "d e f g"] and sum(r.doc_id is None for r in apart) == 1
    cut = corpus_pipeline.drop_repeated_passages(spark, docs.where("doc_id = 2"), SF).collect()
    assert [len(words(r.text)) for r in cut] == [1]  # all windows but the first start earlier

"""The label model on votes of known accuracy, the classifier on held-out labels, and awkward rows."""

import numpy as np

from quire.llm.quality import Words, classify, fit_label_model, good_documents
from quire.llm.queries import op4_quality_classifier, table

#: Half of the labels there hold some 220 toxic texts; the smaller tables have too few to learn from.
SF = "/root/testdata/sf0.1"


def test_label_model_finds_rates():
    rng = np.random.default_rng(4)
    on_bad, on_good = np.array([0.8, 0.6, 0.7, 0.5]), np.array([0.05, 0.1, 0.02, 0.01])
    bad = rng.random(40_000) < 0.2
    votes = rng.random((len(bad), 4)) < np.where(bad[:, None], on_bad, on_good)
    patterns, counts = np.unique(votes @ (1 << np.arange(4)), return_counts=True)
    model = fit_label_model(patterns, counts.astype(float), labellers=4)
    assert abs(model.bad - 0.2) < 0.02
    assert np.abs(model.on_bad - on_bad).max() < 0.04 and np.abs(model.on_good - on_good).max() < 0.02
    assert model.posterior(np.array([15]))[0] > 0.99 and model.posterior(np.array([0]))[0] < 0.05


def test_label_model_without_votes():
    model = fit_label_model(np.zeros(0, np.int64), np.zeros(0))
    assert 0 < model.bad < 1
    model = fit_label_model(np.array([0]), np.array([100.0]))
    assert model.posterior(np.array([0]))[0] < 0.5


def test_held_out_accuracy(spark):
    """Labels whose id is even train the toxicity scorer, the others judge the result."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    assert len(got) == docs.count()
    held = [r for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in got]
    toxic = [(got[r.doc_id].toxicity >= 0.5, bool(r.toxic)) for r in held if r.toxic is not None]
    good = [(got[r.doc_id].low_quality < 0.5, bool(r.quality)) for r in held if r.quality is not None]
    assert np.mean([a == b for a, b in toxic]) > 0.95
    assert np.mean([a for a, b in toxic if b]) > 0.85 and np.mean([a for a, b in toxic if not b]) < 0.03
    assert np.mean([a == b for a, b in good]) > 0.9
    # One toxic text in twenty is junk without a telling word; those go for their quality.
    caught = [not got[r.doc_id].kept for r in held if r.toxic]
    in_prose = [got[r.doc_id].toxicity >= 0.5 for r in held if r.toxic and r.quality]
    assert np.mean(caught) >= 0.9 and np.mean(in_prose) >= 0.9


def test_traits_of_long_texts():
    """Sameness of a text doesn't depend on its length; a line that is repeated far apart is found in long texts too."""
    rng = np.random.default_rng(1)
    prose = lambda n: " ".join(f"w{min(int(x), 5000)}" for x in rng.zipf(1.3, n))
    line = " ".join(f"v{i}" for i in range(40))
    texts = [prose(200), prose(30_000), " ".join([line] * 20), " ".join([line] * 800)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    same = Words(data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])).traits()["sameness"]
    assert abs(same[0] - same[1]) < 0.15 and abs(same[2] - same[3]) < 1e-9 and same[2] > 0.6


def test_query_is_deterministic(spark):
    a, b = (sorted(map(tuple, op4_quality_classifier(spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert [x[0] for x in a] == [x[0] for x in b]
    assert np.allclose([x[2:4] for x in a], [x[2:4] for x in b], atol=1e-9)


def test_awkward_rows(spark):
    prose = "the river ran slowly past the old mill and the children watched it from the wooden bridge "
    rows = [(i, prose * (i % 4 + 1), "k") for i in range(60)] + [(100 + i, "!!## $$$ %% ## !! BUY" * 8, "k") for i in range(20)]
    rows += [(200, None, "k"), (201, "", "k"), (202, " \n\t", None), (None, prose, "k"), (3, prose * 4, "k"), (203, prose * 5000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, low_quality string")
    labels = spark.createDataFrame([(1, 1, 0), (100, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (None, labels, labels.limit(0)):
        got = classify(df, given).collect()
        assert len(got) == len(rows)
        for r in got:
            assert 0 <= r.low_quality <= 1 and r.toxicity == 0
            if r.n_words == 0:
                assert r.low_quality == 1 and not r.kept
    kept = good_documents(df, labels)
    assert kept.columns == df.columns
    own = {r.doc_id for r in kept.collect()}
    assert not own & {200, 201, 202} and not own & set(range(100, 120)) and set(range(60)) <= own
    assert classify(df.limit(0), labels).count() == 0 and good_documents(df.limit(0)).count() == 0

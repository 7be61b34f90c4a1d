"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer.

1. Labellers look at one trait of a text each and fire on what seems bad.  Patterns of votes
   are counted over all documents; there are at most 2**len(LABELLERS).
2. Expectation-maximisation on those counts estimates how often each labeller fires on bad
   and on good documents, and with that the posterior of every pattern.
3. A logistic scorer on hashed word shapes (case, digits, symbols, repetition; averaged over
   the text's words) is fitted to posteriors of a sample of ``sample_rows`` documents.
4. Where a table of labels has toxicity, a second logistic scorer on hashed words and word
   beginnings is fitted to at most ``labelled_rows`` labelled documents.  It has weights only
   for features whose presence depends on the label (``CHI_SQUARE``); copies share one vote.

Both scorers then judge every whole text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import BYTE_CODE, LOWER, U, mix, prefix_sums, return_freed_memory, slices, span_hash, word_spans
from .shared import Tables, bound_batches

#: Each labeller: a trait of a text, and the least value at which it fires.
LABELLERS = (("symbols", 0.05), ("capitals", 0.4), ("bare", 0.05), ("repeats", 0.2), ("sameness", 0.6), ("length", 2.0), ("marks", 0.02))
SHAPE_BITS, WORD_BITS = 12, 18
#: Words among which sameness looks for repeats.
STRETCH = 200
#: Beginnings of words, in bytes, that are features of the toxicity scorer beside whole words.
BEGINNINGS = (4, 5, 6)

#: Least chi-square of a feature and the toxicity label; chance alone seldom brings one of 2**WORD_BITS features there.
CHI_SQUARE = 20.0

_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 128)
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"!#$%&*+<=>@\\^_{}~|", np.uint8))
_SHAPE = np.where(_UPPER, 65, np.where(_LETTER, 97, np.where(_DIGIT, 48, np.arange(256)))).astype(np.uint8)


def _counts(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[ends] - sums[starts]


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


class Words:
    """Words of a slice of texts, their hashes and features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, self.first = word_spans(data, offsets)
        self.sums = prefix_sums(BYTE_CODE[LOWER[data]])
        self.hashes = span_hash(self.sums, self.starts, self.ends)
        self.n = np.diff(self.first)
        self.repeat = np.zeros(len(self.hashes), bool)
        self.repeat[1:] = self.hashes[1:] == self.hashes[:-1]
        self.repeat[self.first[:-1][self.n > 0]] = False

    def shapes(self) -> np.ndarray:
        """Hashed shapes of the words: runs of one kind of character count once."""
        shape = _SHAPE[self.data]
        keep = np.ones(len(shape), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[self.starts] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        hashes = span_hash(prefix_sums(BYTE_CODE[shape[keep]]), at[self.starts], at[self.ends])
        return (mix(hashes + self.repeat.astype(U)) >> U(64 - SHAPE_BITS)).astype(np.int64)

    def toxic_features(self) -> np.ndarray:
        """Hashed whole words and beginnings, a row a word."""
        own = [self.hashes] + [span_hash(self.sums, self.starts, np.minimum(self.starts + k, self.ends)) + U(k) for k in BEGINNINGS]
        return (mix(np.stack(own, 1)) >> U(64 - WORD_BITS)).astype(np.int64)

    def traits(self) -> dict[str, np.ndarray]:
        """The labellers' traits of every text; 0 for texts without words."""
        n, data = np.maximum(self.n, 1), self.data
        symbol = _SYMBOL[data]
        double = np.zeros(len(data), bool)
        double[1:] = symbol[1:] & symbol[:-1]
        upper = _UPPER[data]
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        letters = _per_text(_counts(_LETTER[data] & ~((data >= 0x80) & (data < 0xC0)), self.starts, self.ends), self.first)
        bare = _counts(_LETTER[data] | _DIGIT[data], self.starts, self.ends) == 0
        # Distinct words of stretches of STRETCH words each, so that long texts are judged like short ones.
        text = np.repeat(np.arange(len(self.n)), self.n)
        stretch = (np.arange(len(text)) - self.first[text]) // STRETCH
        _, lead = np.unique(mix(self.hashes + stretch.astype(U) * U(0x9E3779B97F4A7C15)) + text.astype(U) * U(0xD6E8FEB86659FD93), return_index=True)
        distinct = np.bincount(text[lead], minlength=len(self.n))
        length = _per_text(self.ends - self.starts, self.first) / n
        marks = np.isin(data, np.frombuffer(b"!#%$&*|", np.uint8))
        size = np.maximum(_per_text(self.ends - self.starts, self.first), 1)
        return {
            "symbols": _per_text(_counts(double, self.starts, self.ends) > 0, self.first) / n,
            "capitals": _per_text(_counts(upper, self.starts, self.ends), self.first) / np.maximum(letters, 1),
            "bare": _per_text(bare, self.first) / n,
            "repeats": _per_text(self.repeat, self.first) / n,
            "sameness": np.where(self.n >= 20, 1 - distinct / n, 0),
            "length": np.where(self.n >= 20, np.abs(length - 6.0), 0),
            "marks": _per_text(_counts(marks, self.starts, self.ends), self.first) / size,
        }


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(1)):
            traits, pattern = Words(data, offsets).traits(), np.zeros(b - a, np.int32)
            for k, (name, least) in enumerate(LABELLERS):
                pattern |= (traits[name] >= least).astype(np.int32) << k
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pattern)], ["tie", "pattern"])


def _features(batches: Iterator[pa.RecordBatch], toxic: bool) -> Iterator[pa.RecordBatch]:
    """Distinct features of every text with their shares of its words (presence for the toxicity scorer)."""
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(1)):
            words, ids, shares = Words(data, offsets), [], []
            found = words.toxic_features() if toxic else words.shapes()
            for x, y in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                own, count = np.unique(found[x:y], return_counts=True)
                ids.append(own.astype(np.int32))
                shares.append((count / max(1, y - x)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["tie", "ids", "shares"])


@dataclass
class LabelModel:
    """What EM has found: the share of bad documents, firing rates on bad and good ones, posteriors by pattern."""

    bad: float
    on_bad: np.ndarray
    on_good: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that documents with these patterns of votes are bad."""
        votes = (patterns[:, None] >> np.arange(len(self.on_bad)) & 1).astype(bool)
        log = [np.log(p) + np.where(votes, np.log(r), np.log1p(-r)).sum(1) for p, r in ((self.bad, self.on_bad), (1 - self.bad, self.on_good))]
        return 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), steps: int = 200) -> LabelModel:
    """Expectation-maximisation from vote patterns and how many documents have each.

    It starts from "bad where any labeller fires"; rates are smoothed by one document.
    """
    votes = (patterns[:, None] >> np.arange(labellers) & 1).astype(float)
    bad = (patterns > 0) * 0.9 + 0.05
    model = None
    for _ in range(steps):
        w, g = counts * bad, counts * (1 - bad)
        model = LabelModel((w.sum() + 1) / (counts.sum() + 2), (votes.T @ w + 1) / (w.sum() + 2), (votes.T @ g + 1) / (g.sum() + 2))
        now = model.posterior(patterns)
        if np.abs(now - bad).max(initial=0) < 1e-9:
            break
        bad = now
    return model


def _telling(batches: Iterator[pa.RecordBatch], telling: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        ids, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        hit = telling[ids]
        at = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=len(lists)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(ids[hit]))], ["bad", "votes", "ids"])


def telling_features(marked: DataFrame, least_chi: float) -> tuple[DataFrame, np.ndarray]:
    """Rows (bad, votes, ids) with only the features whose presence depends on the label, and which features these are.

    Rows of one class whose four least features agree, as those of near copies do, share one
    vote.  The counts by feature, 2**WORD_BITS at most, are what reaches the driver.
    """
    keyed = marked.withColumn("copy", F.xxhash64("bad", F.slice("ids", 1, 4)))
    sizes = keyed.groupBy("copy").agg((1 / F.count("*")).alias("votes"))
    rows = keyed.join(sizes, "copy").select(F.col("bad").cast("double").alias("bad"), "votes", "ids")
    n, n_bad = rows.agg(F.coalesce(F.sum("votes"), F.lit(0.0)), F.coalesce(F.sum(F.col("votes") * F.col("bad")), F.lit(0.0))).first()
    found = rows.select(F.explode("ids").alias("f"), "votes", "bad").groupBy("f").agg(F.sum("votes").alias("all"), F.sum(F.col("votes") * F.col("bad")).alias("bad")).toPandas()
    with_all, with_bad = found["all"].to_numpy(), found["bad"].to_numpy()
    spread = with_all * (n - with_all) * n_bad * (n - n_bad)
    chi = n * (with_bad * n - with_all * n_bad) ** 2 / np.where(spread > 0, spread, np.inf)
    telling = np.zeros(1 << WORD_BITS, bool)
    telling[found["f"].to_numpy()[chi >= least_chi]] = True
    return rows.mapInArrow(functools.partial(_telling, telling=telling), "bad double, votes double, ids array<int>"), telling


def fit_logistic(ids: list[np.ndarray], shares: list[np.ndarray] | None, target: np.ndarray, size: int, decay: float, steps: int, votes: np.ndarray | None = None, scale: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer; full gradients with momentum scaled by curvature.  Both classes weigh alike.

    Features that no row has keep weight 0; without ``shares`` features are present or not.
    """
    w, bias = np.zeros(size), 0.0
    if not len(ids):
        return w, bias
    row = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])
    flat = np.concatenate(ids).astype(np.int32)
    value = np.concatenate(shares) * np.float32(scale) if shares else np.ones(len(flat), np.float32)
    votes = np.ones(len(ids)) if votes is None else votes
    common = np.bincount(flat, minlength=size) > 0
    bad = target >= 0.5
    weight = votes * np.where(bad, 0.5 / max(1e-9, votes[bad].sum()), 0.5 / max(1e-9, votes[~bad].sum()))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        score = np.bincount(row, value * w[flat], len(ids)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target)
        gradient = np.append(np.bincount(flat, value * error[row], size) + decay * w, error.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, bias = np.where(common, w - move[:-1], 0), bias - move[-1]
    return w, bias


#: Word shares are multiplied by this before they meet the shape scorer's weights.
SHARE_SCALE = 10.0


@dataclass
class Scorers:
    shape: tuple[np.ndarray, float]
    toxic: tuple[np.ndarray, float] | None


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def score(words: Words, scorers: Scorers) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of low quality and of toxicity of each text."""
    n = len(words.n)
    w, bias = scorers.shape
    low = _logistic(_per_text(w[words.shapes()], words.first) / np.maximum(words.n, 1) * SHARE_SCALE + bias)
    toxic = np.zeros(n)
    if scorers.toxic:
        w, bias = scorers.toxic
        features = words.toxic_features()
        telling = w[features] != 0
        text = np.repeat(np.arange(n), words.n)
        key = np.unique((text[:, None] << WORD_BITS | features)[telling])  # presence, not counts
        toxic = _logistic(np.bincount(key >> WORD_BITS, w[key & (1 << WORD_BITS) - 1], n) + bias)
    low[words.n == 0], toxic[words.n == 0] = 1, 0
    return low, toxic


def _scored(batches: Iterator[pa.RecordBatch], scorers: Scorers) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(1)):
            words = Words(data, offsets)
            low, toxic = score(words, scorers)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.n.astype(np.int64)), pa.array(low), pa.array(toxic)], ["id", "n_words", "low_quality", "toxicity"])


def _good(batches: Iterator[pa.RecordBatch], scorers: Scorers, text: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(text)):
            low, toxic = score(Words(data, offsets), scorers)
            yield batch.slice(a, b - a).filter(pa.array((low < threshold) & (toxic < threshold)))


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000, labelled_rows: int = 8_000) -> tuple[LabelModel, Scorers]:
    """The label model and the scorers; see the module.  ``labels`` has the id and ``toxic`` (0, 1 or null).

    Samples are taken by a hash of id and text, so reruns agree.  Votes are counted over all
    documents, features of labelled ones on the cluster; what comes to the driver are the
    sampled documents' shapes and the labelled ones' telling features.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.xxhash64(id_col, text_col).alias("tie"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    counted = base.select("tie", "text").mapInArrow(_votes, "tie long, pattern int").groupBy("pattern").agg(F.count("*").alias("n")).toPandas()
    patterns, counts = counted["pattern"].to_numpy(np.int64), counted["n"].to_numpy(float)
    model = fit_label_model(patterns, counts)
    part = F.pmod(F.xxhash64("tie", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)

    total = float(counts.sum())
    sample = base.where(part < sample_rows / max(total, 1.0)).select("tie", "text")
    voted = sample.mapInArrow(_votes, "tie long, pattern int").toPandas().drop_duplicates("tie").set_index("tie")["pattern"]
    out = sample.mapInArrow(functools.partial(_features, toxic=False), "tie long, ids array<int>, shares array<float>").toArrow()
    ids, shares = ([x.values.to_numpy() for x in out.column(k)] for k in ("ids", "shares"))
    ties = out.column("tie").to_numpy()
    target = model.posterior(voted.loc[ties].to_numpy(np.int64)) if len(ties) else np.zeros(0)
    shape = fit_logistic(ids, shares, target, 1 << SHAPE_BITS, 1e-4, 200, scale=SHARE_SCALE)
    del out, ids, shares, target
    return_freed_memory()
    if labels is None:
        return model, Scorers(shape, None)
    marks = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return model, Scorers(shape, None)
    share = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    marks = marks.where(share < F.when(F.col("toxic") == 1, F.lit(labelled_rows / 2 / sizes[1])).otherwise(F.lit(labelled_rows / 2 / sizes[0])))
    marked = base.join(F.broadcast(marks), "id")  # about labelled_rows ids
    tables = Tables(docs.sparkSession)
    features = marked.select((F.xxhash64("tie", F.lit(2)).bitwiseAND(F.lit(-2)) + F.col("toxic")).alias("tie"), "text").mapInArrow(functools.partial(_features, toxic=True), "tie long, ids array<int>, shares array<float>")
    features = tables.keep(features.select(F.col("tie").bitwiseAND(F.lit(1)).cast("int").alias("bad"), "ids"), "labelled")
    rows, _ = telling_features(features, CHI_SQUARE)
    out = rows.toArrow()
    ids = [x.values.to_numpy() for x in out.column("ids")]
    toxic = fit_logistic(ids, None, out.column("bad").to_numpy(), 1 << WORD_BITS, 1e-4, 150, votes=out.column("votes").to_numpy())
    del out, ids
    return_freed_memory()
    return model, Scorers(shape, toxic)


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **limits: int) -> DataFrame:
    """One row a document: id, n_words, low_quality and toxicity (probabilities) and kept.

    Kept are documents with words whose two probabilities are below ``threshold``.  Null and
    wordless texts have low_quality 1 and toxicity 0.  Without labels of both kinds toxicity
    is 0 everywhere.  Null ids and repeated rows are scored like others; other columns are
    ignored; an empty table gives an empty result.
    """
    _, scorers = fit(docs, labels, id_col, text_col, **limits)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = base.mapInArrow(functools.partial(_scored, scorers=scorers), "id long, n_words long, low_quality double, toxicity double")
    return out.withColumn("kept", (F.col("low_quality") < threshold) & (F.col("toxicity") < threshold)).withColumnRenamed("id", id_col)


def good_documents(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **limits: int) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``classify`` keeps; none is shuffled."""
    _, scorers = fit(docs, labels, id_col, text_col, **limits)
    return docs.mapInArrow(functools.partial(_good, scorers=scorers, text=docs.columns.index(text_col), threshold=threshold), docs.schema)

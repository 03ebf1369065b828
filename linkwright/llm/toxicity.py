"""Toxicity by cumulative-link ordinal regression over sparse word features.

Severity grades run from 0 (not toxic) to GRADES - 1. One weight vector is shared by all thresholds:
P(grade >= k) = sigmoid(w.x - t_k) with ascending t_k; a document's score is its expected severity, the sum of these
probabilities. The labels say only whether a document is toxic, so toxic examples get their grade from how
much in them tells toxic from clean documents: terciles of that evidence. Features are words and beginnings of words.

The model is fitted on a bounded sample of labelled documents (TRAIN_DOCS, those with the least hash of doc_id); every
document is scored on its whole text. A document is rejected if P(grade >= 1) reaches REJECT.

Defined results: a null or empty text has no features and the severity of an empty document, and is kept; a null doc_id
is scored like any other; repeated rows get equal scores; with no toxic or no clean label nothing is rejected and the
severity is 0; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, table, tune

GRADES = 4
REJECT = 0.5
#: Labelled documents that the fit uses at most; the driver holds their words only.
TRAIN_DOCS = 10_000
#: A feature is a word, or a beginning of words, in at least so many training documents.
MIN_DOCS = 5
#: Lengths of the beginnings, in characters.
STEMS = range(3, 8)
ROUNDS = 1500
PENALTY = 0.002
#: Twice the log likelihood ratio by which a feature tells toxic from clean documents, at least.
SURE = 14.0
#: Words whose features a worker keeps.
CACHE_ENTRIES = 250_000

#: Capitals become small and ASCII signs become blanks, all in one pass over the bytes.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def features(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, which end in *."""
    text = word.decode()
    return [word, *(text[:k].encode() + b"*" for k in STEMS if k < len(text))]


class Known(dict):
    """Word -> which of some features it has."""

    def __init__(self, only: set[bytes]):
        self.only = only

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        value = tuple(f for f in features(word) if f in self.only)
        if len(word) <= 64 and len(self) < CACHE_ENTRIES:
            self[word] = value
        return value

    def counts(self, found: list[bytes]) -> Counter:
        return Counter(chain.from_iterable(filter(None, map(self.__getitem__, found))))


@dataclass
class Model:
    """weights: feature -> weight for log(1 + count); thresholds ascend."""

    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def scorer(self):
        """text -> P(grade >= k) for k = 1, 2, ..."""
        known = Known(set(self.weights))

        def at_least(text: str | None) -> list[float]:
            z = sum(self.weights[f] * math.log1p(n) for f, n in known.counts(words(text)).items()) if self.weights else 0.0
            return [1 / (1 + math.exp(min(700.0, max(-700.0, t - z)))) for t in self.thresholds]

        return at_least


def grades(counts: list[dict[bytes, int]], toxic: np.ndarray, telling: dict[bytes, float]) -> np.ndarray:
    """0 for clean documents, 1 to GRADES - 1 for toxic ones by their weighted evidence."""
    evidence = np.array([sum(math.log1p(n) * telling[f] for f, n in c.items()) for c in counts])
    out = np.zeros(len(counts), int)
    if (toxic == 1).any():
        cuts = np.quantile(evidence[toxic == 1], np.linspace(0, 1, GRADES)[1:-1])
        out[toxic == 1] = 1 + np.searchsorted(cuts, evidence[toxic == 1], side="right")
    return out


class Sparse:
    """A matrix of few values: value[i] stands in row[i], column[i]."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = row, column, value, shape

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def turned_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * v[self.row], self.shape[1])


def fit_ordinal(x: Sparse | np.ndarray, y: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the penalised likelihood of the cumulative-link model.

    The first threshold is free and the others lie above it by exponentials; accelerated gradient ascent.
    """
    if not isinstance(x, Sparse):
        x = Sparse(*np.nonzero(x), x[np.nonzero(x)], x.shape)
    levels, total = int(y.max()), len(y)
    # examples of one grade without any feature, most of them, count as one
    some = np.unique(x.row)
    plain = np.ones(total, bool)
    plain[some] = False
    grades_seen, numbers = np.unique(y[plain], return_counts=True)
    weight = np.concatenate([np.ones(len(some)), numbers])
    mean_at_least = [np.mean(y >= k) for k in range(1, levels + 1)]
    x, y = Sparse(np.searchsorted(some, x.row), x.column, x.value, (len(some) + len(grades_seen), x.shape[1])), np.concatenate([y[some], grades_seen])
    w = np.zeros(x.shape[1])
    rate = np.clip(mean_at_least, 1e-4, 1 - 1e-4)
    base = -np.log(rate / (1 - rate))
    t = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 0.05))])
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -35, 35)))
    m, v = np.zeros(len(w) + len(t)), np.zeros(len(w) + len(t))
    for step in range(1, rounds + 1):
        cuts = np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])
        z = x.times(w)
        up = np.column_stack([np.ones(len(y)), *(sigmoid(z - c) for c in cuts), np.zeros(len(y))])
        rows = np.arange(len(y))
        p = np.maximum(up[rows, y] - up[rows, y + 1], 1e-9)
        slope = up * (1 - up)
        by_z = weight * (slope[rows, y] - slope[rows, y + 1]) / p
        each = weight[:, None] * slope / p[:, None]
        by_cut = np.array([each[y == k - 1, k].sum() - each[y == k, k].sum() for k in range(1, levels + 1)]) / total
        grad_t = np.concatenate([[by_cut.sum()], [np.exp(t[j]) * by_cut[j:].sum() for j in range(1, levels)]])
        grad = np.concatenate([x.turned_times(by_z) / total - penalty * w / math.sqrt(total), grad_t])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.08 * (1 - 0.9 * step / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w += move[: len(w)]
        t += move[len(w) :]
    return w, np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])


def fit(examples: list[tuple[dict[bytes, int], int]], telling: dict[bytes, float]) -> Model:
    """The model of (counts of telling features, toxic) examples. telling: feature -> strength."""
    toxic = np.array([e[1] for e in examples])
    if not len(toxic) or toxic.min() == toxic.max() or not telling:
        return Model()
    counts = [e[0] for e in examples]
    place = {w: i for i, w in enumerate(sorted(telling))}
    cells = [(i, place[w], math.log1p(n)) for i, c in enumerate(counts) for w, n in c.items()]
    row, column, value = map(np.array, zip(*cells, strict=True)) if cells else (np.empty(0, int), np.empty(0, int), np.empty(0))
    x = Sparse(row, column, value, (len(counts), len(place)))
    y = np.unique(grades(counts, toxic, telling), return_inverse=True)[1]
    w, cuts = fit_ordinal(x, y)
    return Model({k: float(w[i]) for k, i in place.items()}, [float(c) for c in cuts])


#: Documents whose features are held at once: a document has several features for each distinct word.
SLICE = 64


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (w, toxic): each document's distinct features."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            own = [dict.fromkeys(chain.from_iterable(map(features, set(words(t))))) for t in part.column(0).to_pylist()]
            toxic = np.repeat(np.array(part.column(1).to_pylist(), np.int32), [len(f) for f in own])
            yield pa.RecordBatch.from_arrays([pa.array(list(chain.from_iterable(own)), pa.binary()), pa.array(toxic)], names=["w", "toxic"])


def _counted(only: set[bytes]):
    """(text, toxic) -> (counts, toxic), with the counts of some features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.binary(), pa.int32())
        known = Known(only)
        for batch in batches:
            own = [known.counts(words(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(c.items()) for c in own], kind), batch.column(1).cast(pa.int32())], names=["counts", "toxic"])

    return run


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the TRAIN_DOCS labelled documents whose doc_id has the least hash.

    The driver gets the features of the sample that tell toxic from clean documents, and their counts in it: the sample
    bounds both.
    """
    named = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    # TRAIN_DOCS ids and labels are small enough to go to every task
    texts = materialise(spark, docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"), "toxic-sample", gather=True)
    schema = "counts map<binary,int>, toxic int"
    n = texts.agg(F.coalesce(F.sum(F.when(F.col("toxic") > 0, 1)), F.lit(0)).alias("bad"), F.count("*").alias("all")).first()
    seen = texts.mapInArrow(_seen, "w binary, toxic int")
    tallies = seen.groupBy("w").agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("bad"), F.count("*").alias("all")).where(F.col("all") >= MIN_DOCS)
    bad, all_bad, some, everyone = F.col("bad").cast("double"), float(n["bad"]), F.col("all").cast("double"), float(n["all"])

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    rate = all_bad / max(everyone, 1.0)
    ratio = 2 * (term(bad, some * rate) + term(some - bad, some * (1 - rate)) + term(F.lit(all_bad) - bad, (everyone - some) * rate) + term(everyone - all_bad - some + bad, (everyone - some) * (1 - rate)))
    strong = tallies.where(bad > some * rate).select("w", ratio.alias("sure")).where(F.col("sure") >= SURE).orderBy(F.desc("sure"), "w")
    telling = {bytes(r["w"]): r["sure"] for r in strong.collect()}
    rows = texts.mapInArrow(_counted(set(telling)), schema).toArrow()
    pairs = zip(rows.column("counts").to_pylist(), rows.column("toxic").to_pylist(), strict=True)
    return fit([({bytes(w): k for w, k in c}, int(toxic > 0)) for c, toxic in pairs], telling)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, p_toxic, rejected) of every row."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_least = model.scorer()
        for batch in batches:
            found = [at_least(t) for t in batch.column(1).to_pylist()]
            first = [p[0] if p else 0.0 for p in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([math.fsum(p) for p in found], pa.float64()), pa.array(first, pa.float64()), pa.array([p >= REJECT for p in first], pa.bool_())], names=["doc_id", "severity", "p_toxic", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, severity double, p_toxic double, rejected boolean")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model rejects; all columns stay."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_least = model.scorer()
        for batch in batches:
            found = (at_least(t) for t in batch.column(at).to_pylist())
            yield batch.filter(pa.array([not p or p[0] < REJECT for p in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(spark, docs, table(spark, sf_dir, "labels")))

"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the presence of words and of word beginnings. One weight vector is shared by all
ordered thresholds: P(grade <= k) = sigmoid(threshold_k - w.x). The output is the expected
severity, the sum of P(grade > k) over the thresholds.

The labels only say toxic or not. Grade 0 is not toxic; a toxic text has grade 1, 2 or 3 by how
many different toxic words it holds (up to 2, up to 5, more), where toxic words are those words
that the labels themselves tie to the toxic class.

Scale: the model is fitted on at most max_train labelled texts, one for each id, chosen by a hash
of their id among those that are there. All features of these texts that pass the level of
significance are used, so what the driver gets and what tasks are sent is bounded by the sample.
Scoring is map-only over whole texts; nothing else is shuffled.

Edge cases: null and empty texts have no features and the severity of a text without any; rows
without a label count and rows of unknown ids don't; without labels of both classes every
severity is 0; repeated labels of an id count once, as toxic if any says so; of several texts with
one id the first in their order is learnt from; further columns pass through, but for those with the
name of a result, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forget, held, small_batches, text_or_empty, utf8

MAX_TRAIN = 20_000
LEAST_SEEN = 3
CHANCE = 0.05  # expected number of features chosen by chance alone
BEGINNINGS = range(4, 9)
GRADES = 3
REJECT_FROM = 0.5
WORDS_HELD = 150_000
COUNTED = 200_000
PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


def features(word: str) -> list[str]:
    """The word without punctuation, and its beginnings (marked by a trailing *), in lower case."""
    word = word.strip(PUNCTUATION).lower()
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)] if word else []


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, score: np.ndarray) -> np.ndarray:
        short_of = self.thresholds[None, :] - score[:, None]
        return np.where(short_of > 500, 0.0, 1 / (1 + np.exp(np.clip(short_of, -500, 500)))).sum(1)


class Hits(dict):
    """Numbers of the chosen features by word as it stands in the text."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = tuple(self.index[x] for x in features(word) if x in self.index)
        if len(self) >= WORDS_HELD:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out

    def of(self, text: str) -> list[int]:
        found: set[int] = set()
        for x in filter(None, map(self.__getitem__, set(text.split()))):
            found.update(x)
        return sorted(found)


def _count(batches):
    """(feature, toxic texts, other texts) of a partition, summed as far as COUNTED features reach."""
    toxic, other = Counter(), Counter()

    def send():
        names = sorted(toxic.keys() | other.keys())
        for at in range(0, len(names), 10_000):
            part = names[at : at + 10_000]
            yield pa.RecordBatch.from_pydict({"feature": part, "n_toxic": pa.array([toxic[x] for x in part], pa.int64()), "n_other": pa.array([other[x] for x in part], pa.int64())})

    for batch in batches:
        for text, bad in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            (toxic if bad else other).update({x for word in set((text or "").split()) for x in features(word)})
            if len(toxic) + len(other) >= COUNTED:
                yield from send()
                toxic.clear()
                other.clear()
    yield from send()


def choose(sample: DataFrame, n_toxic: int, n_other: int) -> list[str]:
    """The features tied most strongly to the toxic class, by the likelihood ratio of the two shares.

    A feature must pass the level at which CHANCE of all candidates would pass without any tie.
    """
    counts = cut(sample.mapInArrow(_count, "feature string, n_toxic long, n_other long").groupBy("feature").agg(F.sum("n_toxic").alias("t"), F.sum("n_other").alias("o")).where(F.col("t") >= LEAST_SEEN), "toxicity-counts")
    level = 2 * np.log(max(counts.count(), 1) / CHANCE)
    t, o = F.col("t"), F.col("o")
    share = n_toxic / (n_toxic + n_other)
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen / ((t + o) * of))).otherwise(0.0)
    chosen = counts.withColumn("g", F.round(2 * (part(t, share) + part(o, 1 - share)), 6)).where((F.col("g") >= float(level)) & (t / n_toxic > 4 * o / n_other))
    out = sorted(r["feature"] for r in chosen.select("feature").collect())
    forget(counts)
    return out


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, n_features: int, penalty: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of the proportional-odds model, by Adam on the penalised likelihood."""
    at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    which = np.fromiter((k for x in rows for k in x), np.int64, len(at))
    w, base, gaps = np.zeros(n_features), 2.0, np.zeros(GRADES - 1)
    held = np.concatenate([w, [base], gaps])
    m, v = np.zeros_like(held), np.zeros_like(held)

    def sig(x):
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    for step in range(1, rounds + 1):
        w, base, gaps = held[:n_features], held[n_features], held[n_features + 1 :]
        cuts = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(at, w[which], len(rows))
        ends = np.concatenate([[-np.inf], cuts, [np.inf]])
        up, low = sig(ends[grades + 1] - score), sig(ends[grades] - score)
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / p / len(rows), low * (1 - low) / p / len(rows)
        d_cut = np.array([-d_up[grades == k].sum() + d_low[grades == k + 1].sum() for k in range(GRADES)])
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate([np.bincount(which, (d_up - d_low)[at], n_features) + penalty * w / 10, [tail[0]], tail[1:] * np.exp(gaps)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        held = held - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return held[:n_features], held[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(held[n_features + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on the labelled texts among docs; labels has doc_id and toxic (0 or 1)."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = cut(marks.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "toxicity-marks")
    sample = texts.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # max_train ids at most
    sample = cut(sample, "toxicity-sample")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model({}, np.zeros(0), np.full(GRADES, np.inf))
    names = choose(sample, n[1], n[0])
    index = {x: k for k, x in enumerate(names)}
    words = np.array([not x.endswith("*") for x in names] or [False])

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def hits(column: pa.Array) -> pa.Array:
        table = Hits(index)
        return pa.array([table.of(x or "") for x in column.to_pylist()], pa.list_(pa.int32()))

    found = sample.select("doc_id", "toxic", hits("text").alias("hits")).collect()
    forget(marks, sample)
    found.sort(key=lambda r: r["doc_id"])
    rows = [r["hits"] for r in found]
    said = np.array([int(words[x].sum()) if x else 0 for x in rows])
    grades = np.where(np.array([r["toxic"] for r in found]) > 0, 1 + (said > 2) + (said > 5), 0)
    weights, thresholds = fit_ordinal(rows, grades, len(names))
    return Model(index, weights, thresholds)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with severity (double, from 0 to 3)."""
    small_batches(df.sparkSession)
    index, weights, thresholds = model.index, model.weights, model.thresholds
    key = ("toxicity", hashlib.md5("\n".join(index).encode()).hexdigest())

    @F.arrow_udf(T.DoubleType())
    def severity(column: pa.Array) -> pa.Array:
        table = held(key, lambda: Hits(index))
        scores = np.array([float(weights[x].sum()) if (x := table.of(t.decode("utf-8", "replace"))) else 0.0 for t in utf8(column)])
        return pa.array(Model(index, weights, thresholds).severity(scores))

    return df.withColumn("severity", severity(text_or_empty(text)))


def assess(docs: DataFrame, labels: DataFrame, text: str = "text", reject_from: float = REJECT_FROM) -> DataFrame:
    """docs with severity and toxic, by a model fitted on the labelled ones among them."""
    return score(docs, train(docs, labels, text=text), text).withColumn("toxic", F.col("severity") >= reject_from)

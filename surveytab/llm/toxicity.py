"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other. Each has a logistic model of the words that a
document holds, and the log odds that the chain gave to the earlier categories; in training, these
come from models that have not seen the document (out of fold), as they will in use.

The training documents are a bounded sample of the labelled ones; all texts are scored whole, in one
pass, with a table from word to weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written
from .text import hashed_words

BITS = 18  # words are hashed to 2^18 features
TRAIN_DOCS = 12_000  # labelled documents that are learned from, sampled by doc_id
WORDS = 300  # features that a category's model may use
LEAST_DOCS = 4  # training documents that must hold a feature
FOLDS = 3
RIDGE = 1.0
CUES = 3  # different cue words of a severe document
CATEGORIES = ("toxic", "severe")
_U = np.uint64


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - BITS)).astype(np.int64)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Link:
    """One category's model: weights of features, of earlier categories' log odds, a constant."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    constant: float


class Sparse:
    """Which of ``rows`` documents hold which feature."""

    def __init__(self, docs: list[np.ndarray]):
        self.rows = len(docs)
        self.row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        self.feature = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)

    def counts(self, of: np.ndarray) -> np.ndarray:
        return np.bincount(self.feature, weights=of[self.row], minlength=1 << BITS)

    def columns(self, features: np.ndarray) -> np.ndarray:
        place = np.full(1 << BITS, -1)
        place[features] = np.arange(len(features))
        out = np.zeros((self.rows, len(features)))
        at = place[self.feature]
        out[self.row[at >= 0], at[at >= 0]] = 1
        return out


def telling(x: Sparse, y: np.ndarray, use: np.ndarray, most: int = WORDS) -> np.ndarray:
    """The features whose share among the positive documents differs most, in standard errors."""
    n1, n0 = max((use * y).sum(), 1), max((use * (1 - y)).sum(), 1)
    c1, c0 = x.counts(use * y), x.counts(use * (1 - y))
    p = (c1 + c0 + 1) / (n1 + n0 + 2)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    z[c1 + c0 < LEAST_DOCS] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] > 3])


def _fit_link(x: Sparse, y: np.ndarray, earlier: np.ndarray, use: np.ndarray) -> Link:
    features = telling(x, y, use)
    held = use > 0
    w = _logistic(np.column_stack([x.columns(features), earlier])[held], y[held])
    k = len(features)
    return Link(features, w[:k], w[k:-1], float(w[-1]))


def _odds(x: Sparse, link: Link, earlier: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << BITS)
    table[link.features] = link.weights
    words = np.bincount(x.row, weights=table[x.feature], minlength=x.rows)
    return np.clip(words + earlier @ link.earlier + link.constant, -15, 15)


def fit_chain(docs: list[np.ndarray], labels: np.ndarray) -> list[Link]:
    """Models for the columns of ``labels`` in order; ``docs`` has each document's features."""
    x, n = Sparse(docs), len(docs)
    fold = np.arange(n) % FOLDS
    earlier, chain = np.zeros((n, 0)), []
    for j in range(labels.shape[1]):
        y = labels[:, j].astype(float)
        unseen = np.zeros(n)
        for f in range(FOLDS):
            link = _fit_link(x, y, earlier, (fold != f).astype(float))
            unseen[fold == f] = _odds(x, link, earlier)[fold == f]
        chain.append(_fit_link(x, y, earlier, np.ones(n)))
        earlier = np.column_stack([earlier, unseen])
    return chain


@dataclass
class Chain:
    links: list[Link]

    def __post_init__(self):
        self.tables = [np.zeros(1 << BITS) for _ in self.links]
        for t, link in zip(self.tables, self.links):
            t[link.features] = link.weights
        self.used = np.any([t != 0 for t in self.tables], axis=0) if self.links else np.zeros(1 << BITS, bool)

    def __getstate__(self):
        return self.links

    def __setstate__(self, links):
        self.links = links
        self.__post_init__()

    def probabilities(self, text: pa.Array) -> Iterator[np.ndarray]:
        """For a few rows at a time, the probabilities of all categories."""
        for _, hashes, firsts in hashed_words(text, letters=True):
            features, rows = _features(hashes), len(firsts) - 1
            at = np.flatnonzero(self.used[features])
            row = np.searchsorted(firsts, at, "right") - 1
            row, feature = np.divmod(np.unique(row * (1 << BITS) + features[at]), 1 << BITS)
            odds = np.zeros((rows, 0))
            for table, link in zip(self.tables, self.links):
                words = np.bincount(row, weights=table[feature], minlength=rows)
                odds = np.column_stack([odds, np.clip(words + odds @ link.earlier + link.constant, -15, 15)])
            yield 1 / (1 + np.exp(-odds))


def training_documents(documents: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS):
    """Features and ``toxic`` labels of a sample of the labelled documents, in the order of a hash. Null
    ids, labels and texts are left out; a document is toxic if any of its labels says so."""
    small_batches(documents.sparkSession)
    given = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, train_docs / max(given.count(), 1))
    order = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000))
    given = written(given.withColumn("order", order).filter(F.col("order") < int(share * 1_000_000)), "labelled")
    chosen = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(given), "doc_id")

    def run(batches):
        for batch in batches:
            for row, hashes, firsts in hashed_words(batch.column(1), letters=True):
                held = [np.unique(_features(hashes[a:b])).astype(np.int32).tobytes() for a, b in zip(firsts[:-1], firsts[1:])]
                part = batch.slice(row, len(held))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(held, pa.binary())], ["doc_id", "toxic", "order", "held"])

    rows = chosen.select("doc_id", "text", "toxic", "order").mapInArrow(
        run, "doc_id bigint, toxic int, order bigint, held binary").collect()
    rows.sort(key=lambda r: (r["order"], r["doc_id"], r["held"]))
    return [np.frombuffer(r["held"], np.int32) for r in rows], np.array([r["toxic"] for r in rows])


def category_labels(docs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """``toxic`` as it is labelled; ``severe`` for the toxic documents that hold CUES or more
    of the words which the labels show to be toxic documents' own."""
    x, y = Sparse(docs), (toxic == 1).astype(float)
    cues = telling(x, y, np.ones(len(docs)))
    own = cues[x.counts(y)[cues] > 0.9 * x.counts(np.ones(len(docs)))[cues]]
    return np.column_stack([y, y * (x.columns(own).sum(axis=1) >= CUES)])


def fit_toxicity(documents: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Chain:
    docs, toxic = training_documents(documents, labels, train_docs)
    return Chain(fit_chain(docs, category_labels(docs, toxic)) if len(docs) else [])


def toxicity(documents: DataFrame, chain: Chain, categories=CATEGORIES) -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` for each, and ``toxic`` (the first one is at
    least one half), for every row of ``documents``. A null or empty text holds no words; if nothing
    could be learned, all probabilities are 0.0."""
    small_batches(documents.sparkSession)
    shared, names = documents.sparkSession.sparkContext.broadcast(chain), [f"p_{c}" for c in categories]

    def run(batches):
        for batch in batches:
            p = np.concatenate([np.zeros((0, len(shared.value.links))), *shared.value.probabilities(batch.column(1))])
            if not shared.value.links:
                p = np.zeros((batch.num_rows, len(names)))
            columns = [pa.array(p[:, j]) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(p[:, 0] >= 0.5)], ["doc_id", *names, "toxic"])

    schema = "doc_id bigint, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean"
    return documents.select("doc_id", "text").mapInArrow(run, schema)

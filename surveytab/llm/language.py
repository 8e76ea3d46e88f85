"""Language identification by the nearest of several centroids per language.

A text is the vector of its hashed character 1- to 3-grams (letters, lower case, runs of
anything else as one space), weighted by log(1 + count) * idf and scaled to length 1. Document
frequencies come from all training documents. The centroids of a language are found by
spherical k-means on a bounded sample of its documents, in one task per language. A text
gets the language of the centroid with the largest cosine; it is rejected if that cosine is below
what nearly all of the centroid's own training documents reach, a low quantile over all of them,
whatever a few mislabelled ones do. A short text shows few n-grams and is far from any centroid, so
less is asked of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import fresh, small_batches

UNKNOWN = "und"
BITS = 12
SAMPLE = 400  # training documents per language that shape its centroids
CENTROIDS = 3  # per language
ROUNDS = 10
SHORT = 300  # n-grams at which a text has to be half as near as a long one
LOST = 0.005  # share of a centroid's training documents that may be too far away
FEW = 10  # with so many training documents, half of their quantile is asked
MOST_LANGUAGES = 1000  # 1000 x 3 x 4096 floats: 49 MB at most
CHUNK = 1 << 20  # characters worked on at once
_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams; None if the text has no letter."""
    counts = np.zeros(1 << BITS, np.int64)
    found = False
    for start in range(0, len(text or ""), CHUNK):
        piece = text[max(0, start - 2) : start + CHUNK].lower()
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), "<u4")
        letter = _letters()[codes]
        if not letter.any():
            continue
        found = True
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        codes = np.where(letter, codes, 32).astype(np.uint32)[keep]
        gram = np.zeros(len(codes), np.uint32)
        for n in range(3):
            if len(codes) <= n:
                break
            gram = gram[: len(codes) - n] * _MUL[0] + codes[n:]
            mixed = (gram ^ (gram >> np.uint32(15))) * _MUL[1 + n % 2]
            counts += np.bincount(mixed >> np.uint32(32 - BITS), minlength=1 << BITS)
    return counts if found else None


@dataclass
class LanguageModel:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    least: np.ndarray  # cosine below which a text is rejected

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        for text in texts:
            counts = ngram_counts(text) if len(self.languages) else None
            if counts is None:
                yield UNKNOWN, 0.0, True
                continue
            v, n = _vector(counts, self.idf), int(counts.sum())
            cosines = self.centroids @ v
            best = int(np.argmax(cosines))
            score = float(min(max(cosines[best], 0.0), 1.0))
            yield self.languages[best], score, bool(score < self.least[best] * n / (n + SHORT))


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(counts) * idf).astype(np.float32)
    length = float(np.sqrt(v @ v))
    return v / length if length else v


def _clusters(idf: np.ndarray, k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "text"])
        vectors = [_vector(c, idf) for c in map(ngram_counts, group["text"]) if c is not None]
        if not vectors:
            return pd.DataFrame({"lang": [], "k": [], "centroid": []})
        x = np.array(vectors)
        centers = x[:1]
        while len(centers) < min(k, len(x)):  # farthest first
            nearest = (x @ centers.T).max(axis=1)
            centers = np.vstack([centers, x[int(np.argmin(nearest))]])
        for _ in range(ROUNDS):
            mine = (x @ centers.T).argmax(axis=1)
            sums = np.array([x[mine == j].sum(axis=0) if (mine == j).any() else centers[j] for j in range(len(centers))])
            centers = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "k": range(len(centers)), "centroid": list(centers)})

    return run


def _document_frequencies(texts: DataFrame) -> np.ndarray:
    """How many texts have each n-gram; the last entry is the number of texts."""
    def run(batches):
        total = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = ngram_counts(text)
                if counts is not None:
                    total[:-1] += counts > 0
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    found = texts.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((1 << BITS) + 1, np.int64)
    for row in found:
        out[row["at"]] = row["n"]
    return out


def _limits(training: DataFrame, model: LanguageModel, lost: float) -> np.ndarray:
    """The ``lost`` quantile, for each centroid, of the cosines of all training documents of its language that
    are nearest to it, as those of long texts; the least of its language's others, if there are none."""
    at = {lang: [k for k, x in enumerate(model.languages) if x == lang] for lang in model.languages}
    shared = training.sparkSession.sparkContext.broadcast((model, at))

    def run(batches):
        model, at = shared.value
        for batch in batches:
            ks, cosines = [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = ngram_counts(text) if lang in at else None
                if counts is not None:
                    near, n = model.centroids[at[lang]] @ _vector(counts, model.idf), int(counts.sum())
                    ks.append(at[lang][int(np.argmax(near))])
                    cosines.append(float(near.max()) * (n + SHORT) / n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ks, pa.int64()), pa.array(cosines, pa.float64())], ["k", "cosine"])

    found = (
        training.select("text", "lang").mapInArrow(run, "k bigint, cosine double")
        .groupBy("k").agg(F.percentile_approx("cosine", lost, 10_000).alias("least"), F.count("*").alias("n")).collect()
    )
    least = np.zeros(len(model.languages))
    for row in found:
        least[row["k"]] = row["least"] * row["n"] / (row["n"] + FEW)
    for k, lang in enumerate(model.languages):
        if not least[k]:
            least[k] = min((x for x in least[at[lang]] if x), default=0.0)
    return least


def fit_languages(
    training: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, lost: float = LOST
) -> LanguageModel:
    """A model from ``doc_id, text, lang``. Rows with a null text or language are left out;
    at most ``sample`` documents of a language, chosen by doc_id, shape its centroids. How near a text has
    to be to them is found from all documents."""
    small_batches(training.sparkSession)
    training = training.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in training.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    df = _document_frequencies(training.select("text"))
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    if not sizes:
        return LanguageModel(idf, [], np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2 * sample / n))])
    order = F.xxhash64("doc_id", F.lit("language"))
    chosen = (
        training.withColumn("order", order)
        .filter(F.pmod("order", F.lit(1 << 20)) <= F.element_at(share, F.col("lang")) * (1 << 20))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "text")))
        .filter(F.col("rank") <= sample)
    )
    rows = (
        chosen.groupBy("lang")
        .applyInPandas(_clusters(idf, centroids), "lang string, k int, centroid array<float>")
        .collect()
    )
    rows.sort(key=lambda r: (r["lang"], r["k"]))
    model = LanguageModel(
        idf, [r["lang"] for r in rows],
        np.array([r["centroid"] for r in rows], np.float32).reshape(len(rows), 1 << BITS), np.zeros(len(rows)),
    )
    model.least = _limits(training, model, lost)
    return model


def identify(documents: DataFrame, model: LanguageModel) -> tuple[DataFrame, list[str]]:
    """``documents`` with three more columns, and their names (``lang_pred, score, rejected``,
    with underscores added where the table has such columns): the language of the whole text,
    the cosine to its centroid (0 to 1), and whether that is too far. A text that is null or has
    no letter, or any text if nothing was learned, is ``und`` with 0.0, rejected."""
    names = [fresh(documents, c) for c in ("lang_pred", "score", "rejected")]
    schema = T.StructType([*documents.schema, *(
        T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType())))])
    spark, at = documents.sparkSession, documents.columns.index("text")
    shared = spark.sparkContext.broadcast(model)
    small_batches(spark)

    def run(batches):
        for batch in batches:
            found = list(shared.value.predict(batch.column(at).to_pylist()))
            more = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return documents.mapInArrow(run, schema), names


def held_out(doc_id: str = "doc_id"):
    """The third of the documents that is not learned from; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predicted_languages(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row."""
    rows = documents.select("doc_id", "text")
    learn = documents.filter(F.col("doc_id").isNotNull() & ~held_out())
    found, (lang, score, rejected) = identify(rows, fit_languages(learn))
    return found.select(
        "doc_id", held_out().alias("held_out"), F.col(lang).alias("lang_pred"),
        F.col(score).alias("score"), F.col(rejected).alias("rejected"),
    )

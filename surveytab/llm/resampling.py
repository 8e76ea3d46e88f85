"""Importance resampling towards a target: array-scored weights, exact ranks by regular sampling.

A feature is a word (lower-cased ASCII letters, digits, and everything beyond ASCII). It falls into a
bucket, its CRC-32 modulo 10000. A bucket's gain tells how much likelier it is in the target than in
the documents:

    gain = floor(1000 * ln((t + 1)(S + B) / ((s + 1)(T + B))))

with s of S and t of T features of documents and target in it. A document's weight is the sum of the
gains of its features; its score is the weight and a Gumbel number made from a keyed hash
of its id, so the highest scores are a draw without return by weight. Ranks come from parallel
sorting by regular sampling:

1. words become an array of bucket numbers per document, in numpy, written once; the array of gains
   (10000 numbers, whatever the data) is applied to it;
2. each task sorts its rows in runs of bounded length; rows alike are one row with a number of copies;
3. every so-manieth row of each run is a sample (half a million in all at most), and every
   so-manieth sample a splitter, by score and id. Segments between splitters hold nearly equal numbers of rows;
4. counts per segment, added up from the highest, tell which segments hold drawn rows and what rank each
   begins with. Only these segments are exchanged; in each, rows are merged in order and numbered.

Null and empty texts have no features and weigh 0. A null doc_id is hashed as an empty text and
ranks after the others with its score. Rows alike get ranks of their own; which is which does not
matter. Empty tables give no rows; an empty target has T = 0. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches, written
from .text import BLOCK, _cuts, _tables, utf8

BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
RUN_ROWS = 1 << 20  # of a locally sorted run
SEGMENT_ROWS = 1 << 16  # per segment, or more where MOST_SEGMENTS would not do
MOST_SEGMENTS = 1 << 13
SAMPLES = 64  # per segment
_LONG_WORD = 48  # bytes; longer words are hashed one by one
_LAST = np.iinfo(np.int64).max


@lru_cache(maxsize=1)
def _crc_steps() -> np.ndarray:
    """CRC-32 of a byte, by the rule: eight steps of the reflected polynomial 0xEDB88320."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


def _crc_words(data: np.ndarray, starts_of_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of the words of ``data``, and the number of words before each row start."""
    is_word = _tables(True)[0]
    word = is_word[data]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    before[starts_of_rows[starts_of_rows < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    firsts = np.searchsorted(starts, starts_of_rows)
    if not len(starts):
        return np.zeros(0, np.uint32), firsts
    ends = np.flatnonzero(~word)
    row_ends = np.append(starts_of_rows[1:], len(data))
    at = np.searchsorted(ends, starts)
    stop = np.append(ends, len(data))[at]
    stop = np.minimum(stop, row_ends[np.searchsorted(starts_of_rows, starts, "right") - 1])
    lowered = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    length = stop - starts
    order = np.argsort(-length, kind="stable")
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    steps, where, sizes = _crc_steps(), starts[order], length[order]
    for i in range(min(int(sizes[0]), _LONG_WORD)):
        n = int(np.searchsorted(-sizes, -i, "left"))  # words longer than i
        c = crc[:n]
        crc[:n] = steps[(c ^ lowered[where[:n] + i]) & np.uint32(255)] ^ (c >> np.uint32(8))
    for k in range(int(np.searchsorted(-sizes, -_LONG_WORD, "left"))):
        crc[k] = zlib.crc32(lowered[where[k] : where[k] + sizes[k]].tobytes()) ^ 0xFFFFFFFF
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out, firsts


def word_buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of every word, where each row's words start and the last end) for a few rows at a
    time, in order; a long text is cut at white space while it is worked on."""
    data, offsets = utf8(column)
    row, rows = 0, len(column)
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1
        last = min(max(last, row + 1), rows)
        begin, end = int(offsets[row]), int(offsets[last])
        if end - begin <= BLOCK:
            crc, firsts = _crc_words(data[begin:end], offsets[row:last] - begin)
        else:
            parts, start = [], begin
            for cut in _cuts(data, begin, end):
                parts.append(_crc_words(data[start:cut], np.zeros(1, np.int64))[0])
                start = cut
            crc, firsts = np.concatenate(parts), np.zeros(1, np.int64)
        yield (crc % np.uint32(BUCKETS)).astype(np.int16), np.append(firsts, len(crc))
        row = last


def with_buckets(texts: DataFrame) -> DataFrame:
    """``doc_id, buckets`` from ``doc_id, text``: the words' bucket numbers."""
    def run(batches):
        for batch in batches:
            found = list(word_buckets(batch.column(1)))
            buckets = np.concatenate([*(b for b, _ in found), np.zeros(0, np.int16)])
            sizes = np.concatenate([*(np.diff(at) for _, at in found), np.zeros(0, np.int64)])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "buckets"])

    small_batches(texts.sparkSession)
    return texts.mapInArrow(run, "doc_id bigint, buckets array<smallint>")


def bucket_counts(bucketed: DataFrame) -> np.ndarray:
    """How many features fall into each of the 10000 buckets."""
    counts = bucketed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count()
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():  # 10000 rows at most
        out[r["bucket"]] = r["count"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in doubles as the contract says."""
    whole_s, whole_t = float(documents.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([
        math.floor(1000 * math.log((t + 1) * whole_s / ((s + 1) * whole_t)))
        for s, t in zip(documents.astype(float).tolist(), target.astype(float).tolist())
    ], np.int64)


def luck(doc_id: int | None, seed: str = SEED) -> int:
    """The Gumbel number of a document, in thousandths."""
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def sorted_runs(bucketed: DataFrame, gain: np.ndarray, seed: str, least_words: int) -> DataFrame:
    """``doc_id, n_features, weight, score, copies, place``: each task's rows in runs sorted by score and
    id, with their place in the run; rows with too few words have no place."""
    shared = bucketed.sparkSession.sparkContext.broadcast(gain)  # 80 kB

    def scored(batch):
        lists = batch.column(1)
        at = lists.offsets.to_numpy()
        total = np.concatenate([[0], np.cumsum(shared.value[lists.values.to_numpy()[at[0] : at[-1]]])])
        at = at - at[0]
        weight = total[at[1:]] - total[at[:-1]]
        ids = batch.column(0).to_pylist()
        score = weight + np.array([luck(i, seed) for i in ids], np.int64)
        keys = np.array([_LAST if i is None else i for i in ids], np.int64)
        null = np.array([i is None for i in ids], bool)
        return np.stack([keys, null, np.diff(at), weight, score])

    def as_run(parts):
        keys, null, n, weight, score = rows = np.concatenate(parts, axis=1)
        order = np.lexsort((weight, n, null, keys, -score, n < least_words))
        rows = rows[:, order]
        new = np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)) if rows.shape[1] else np.zeros(0, bool)
        at = np.flatnonzero(new)
        copies = np.diff(np.append(at, rows.shape[1]))
        keys, null, n, weight, score = rows[:, at]
        place = pa.array(np.arange(len(at)), mask=n < least_words)
        columns = [pa.array(keys, mask=null.astype(bool)), *map(pa.array, (n, weight, score, copies)), place]
        names = ["doc_id", "n_features", "weight", "score", "copies", "place"]
        return pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in columns], names)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(scored(batch))
                held += batch.num_rows
            if held >= RUN_ROWS:
                yield as_run(parts)
                parts, held = [], 0
        if parts:
            yield as_run(parts)

    names = ("doc_id", "n_features", "weight", "score", "copies", "place")
    return bucketed.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def splitters(runs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores, falling, and ids that part ``rows`` rows of all runs in segments of nearly equal size."""
    segments = min(MOST_SEGMENTS, -(-rows // SEGMENT_ROWS))
    step = max(1, rows // (max(segments, 1) * SAMPLES))
    # A run with fewer than half a step of rows gives none, so there are 2 * rows / step at most.
    samples = runs.filter(F.col("place") % step == step // 2).select("score", "doc_id").toPandas()
    score = samples["score"].to_numpy(np.int64)
    ids = samples["doc_id"].astype("Int64").fillna(_LAST).to_numpy(np.int64)
    order = np.lexsort((ids, -score))
    cuts = order[(np.arange(1, segments) * len(order)) // max(segments, 1)] if len(order) else order
    return score[cuts], ids[cuts]


def _segments(runs: DataFrame, score: np.ndarray, ids: np.ndarray) -> DataFrame:
    """The rows that have a place, with ``segment``, from 0 for the highest scores."""
    shared = runs.sparkSession.sparkContext.broadcast((score, ids))  # MOST_SEGMENTS pairs at most
    names = ["doc_id", "n_features", "weight", "score", "copies"]

    def run(batches):
        scores, ids = shared.value
        for batch in batches:
            s = batch.column(3).to_numpy()
            d = batch.column(0).fill_null(int(_LAST)).to_numpy()
            at, last = np.searchsorted(-scores, -s, "left"), np.searchsorted(-scores, -s, "right")
            while True:  # along the splitters that have the row's score
                behind = at < last
                behind[behind] = ids[at[behind]] < d[behind]
                if not behind.any():
                    break
                at = at + behind
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64))], [*names, "segment"])

    schema = ", ".join(f"{n} bigint" for n in [*names, "segment"])
    return runs.filter("place is not null").select(*names).mapInArrow(run, schema)


def resampled(
    documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``documents`` (doc_id, text): of
    the rows with enough words, the ``percent`` of highest score have ranks from 1, the others null.
    ``target`` has a column ``text``."""
    bucketed = written(with_buckets(documents.select("doc_id", "text")), "buckets")
    wanted = with_buckets(target.select(F.lit(0).cast("bigint").alias("doc_id"), "text"))
    gain = gains(bucket_counts(bucketed), bucket_counts(wanted))
    runs = written(sorted_runs(bucketed, gain, seed, least_words), "runs")
    rows, size = runs.filter("place is not null").agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    draws = percent * size // 100
    placed = _segments(runs, *splitters(runs, rows))
    counts = {r["segment"]: r["n"] for r in placed.groupBy("segment").agg(F.sum("copies").alias("n")).collect()}
    before, begins = 0, []  # of the segments that hold drawn rows
    for segment in range(max(counts, default=-1) + 1):
        if before >= draws:
            break
        begins.append(before)
        before += counts.get(segment, 0)

    fields = ["doc_id", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("bigint")
    start = F.element_at(F.lit(np.array([*begins, 0], np.int64)), F.col("segment").cast("int") + 1)
    order = Window.partitionBy("segment").orderBy(
        F.desc("score"), F.col("doc_id").asc_nulls_last(), "n_features", "weight"
    ).rowsBetween(Window.unboundedPreceding, 0)
    merged = (
        placed.filter(F.col("segment") < len(begins))
        .withColumn("upto", start + F.sum("copies").over(order))
        .select(*fields, F.explode(F.sequence(F.col("upto") - F.col("copies") + 1, "upto")).alias("at"))
        .select(*fields, F.when(F.col("at") <= draws, F.col("at")).alias("rank"))
    )
    others = runs.filter("place is null").select(*fields, "copies").unionByName(
        placed.filter(F.col("segment") >= len(begins)).select(*fields, "copies"))
    undrawn = others.select(*fields, no_rank.alias("rank"), F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("col")
    return merged.unionByName(undrawn)


def drawn(documents: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose doc_id has a rank in ``ranks``. Rows that share
    a doc_id stay together; ids are joined, and only drawn ones are shuffled."""
    chosen = ranks.filter("rank is not null").select("doc_id").distinct()
    return documents.join(chosen, documents["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi")

"""Quality rules: counts of a text's faults, and how much its n-grams look like trusted text.

The score of a document is the mean, over its words and pairs of neighbouring words, of
log p(target) - log p(raw): each is hashed to one of 16384 buckets, and the two multinomials
over the buckets are counted from all trusted documents and from the whole corpus, with
every bucket starting at one. A document is kept if no rule failed it and its score, with a few
neutral features added, reaches a threshold, which is set from a low quantile and the spread of the
trusted documents' own and is never above zero. There are no random choices.

All in column functions. The words of a text are hashed once; windows of words are numbers made
of these hashes, and only a text that has a repeated window is looked at further.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

BUCKETS = 1 << 14
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words
TRUSTED_LOST = 0.001  # share of the trusted documents that may fall below the threshold
SPREAD = (0.25, 0.75)  # the threshold lies lower still, by the distance of these quantiles of the trusted
SHORT = 20  # features that count as neutral in each verdict: few features prove little
MOST_BROADCAST = 1_000_000  # trusted ids sent to all executors at most
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str = "text") -> Column:
    """The words of a text; none for null."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), _SPACE, -1)
    return F.filter(parts, lambda w: w != "")


def _features(hashes: str = "hashes") -> Column:
    """Buckets of the words and of the pairs of neighbouring words."""
    pairs = F.expr(
        f"zip_with(slice({hashes}, 1, greatest(size({hashes}) - 1, 0)), "
        f"slice({hashes}, 2, greatest(size({hashes}) - 1, 0)), (a, b) -> xxhash64(a, b))")
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def with_hashes(documents: DataFrame) -> DataFrame:
    """The columns of ``documents``, and ``hashes``: a number for each word of ``text``."""
    return documents.withColumn("hashes", F.transform(_words(), lambda w: F.xxhash64(w)))


def log_ratios(target: np.ndarray, raw: np.ndarray) -> list[float]:
    """Of the two smoothed multinomials, bucket by bucket."""
    p, q = target + 1, raw + 1
    return [round(x, 6) for x in (np.log(p / p.sum()) - np.log(q / q.sum())).tolist()]


def score(ratios: Column) -> Column:
    """Mean log ratio of a text's features; 0 for a text without words."""
    total = F.aggregate(_features(), F.lit(0.0), lambda s, b: s + F.element_at(ratios, b + 1))
    n = F.greatest(2 * F.size("hashes") - 1, F.lit(1))
    return total / n


def _let(name: str, value: str, then: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _repeated_words(windows: str) -> Column:
    """How many words are in windows (numbers, in order) that occur at least twice."""
    pairs = (
        "flatten(zip_with(slice(t, 1, size(t) - 1), slice(t, 2, size(t) - 1), (a, b) -> "
        "if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>))))"
    )
    covered = (
        "aggregate(sort_array(array_distinct(p)), named_struct('to', 0, 'n', 0), (s, i) -> "
        f"named_struct('to', i + {WINDOW}, 'n', s.n + least({WINDOW}, i + {WINDOW} - s.to)), s -> s.n)"
    )
    inside = _let("t", f"sort_array(transform({windows}, (h, i) -> named_struct('h', h, 'i', i)))", _let("p", pairs, covered))
    return F.expr(f"if(size({windows}) = size(array_distinct({windows})), 0, {inside})").cast("bigint")


def faults(hashed: DataFrame) -> DataFrame:
    """``hashed`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (bigint) and
    ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = ", ".join(f"element_at(hashes, i + {j})" for j in range(WINDOW))
    windows = f"if(size(hashes) > {WINDOW}, transform(sequence(1, size(hashes) - {WINDOW - 1}), i -> xxhash64({parts})), array())"
    found = hashed.withColumn("windows", F.expr(windows)).withColumn("lines", lines)
    found = found.withColumns({
        "n_words": F.size("hashes").cast("bigint"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        "n_repeat_words": _repeated_words("windows"),
    }).drop("windows", "lines")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    score`` for every row of ``documents`` (doc_id, text).

    The trusted documents are those that ``labels`` (doc_id, quality) gives quality 1, repeated
    labels counted once. A null or empty text has no words: it fails. A null doc_id is
    trusted by no label. Without trusted documents every score is that of the smoothed
    multinomials alone, and only the rules decide. Other columns are ignored.
    """
    documents = documents.select("doc_id", "text")
    trusted = written(labels.filter("quality = 1 and doc_id is not null").select(
        F.col("doc_id").alias("trusted_id")).distinct(), "trusted")
    few = trusted.count() <= MOST_BROADCAST
    trusted = F.broadcast(trusted) if few else trusted
    ours = F.col("doc_id") == F.col("trusted_id")
    # Both multinomials in one pass over the corpus.
    counted = (
        with_hashes(documents.join(trusted, ours, "left"))
        .select(F.col("trusted_id").isNotNull().cast("int").alias("t"), F.explode(_features()).alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()
    )
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counted:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    ratios = F.lit(log_ratios(target, raw)) if target.any() else F.array_repeat(F.lit(0.0), BUCKETS)
    scored = faults(with_hashes(documents)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        score(ratios).alias("score"))
    scored = written(scored, "scored")
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    judged = F.col("score") * n / (n + SHORT)
    least = scored.join(trusted, ours).filter("not base_failed").agg(
        F.percentile_approx(judged, [TRUSTED_LOST, *SPREAD], 100_000)).collect()[0][0]
    passes = F.lit(True) if least is None else judged >= F.lit(min(least[0], 0.0) - (least[2] - least[1]))
    return scored.withColumn("kept", ~F.col("base_failed") & passes)

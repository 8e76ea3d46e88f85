"""Secrets in texts: three patterns, and character Markov models for what they miss.

The patterns (assign, access, hex) find the base spans. Their values are the labelled samples
of random strings; the words without digits of a bounded sample of documents are those of
ordinary identifiers. Both train a first-order Markov model over 68 characters, smoothed by the
transitions between small letters, capitals, digits and signs. Any other run of 16 or more such characters
is a secret too (kind ``random``) if the log-likelihood ratio of the models, divided by the number of
transitions, reaches a threshold.

Column functions only. A text is split at the finds of a pattern, and the lengths of pieces
and finds add up to positions in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

# The three patterns and the least lengths of value, key and run.
ASSIGN = (
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12

KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"(?<![\p{L}0-9])[A-Za-z0-9+/_=-]{16,}(?![\p{L}0-9])"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SAMPLE_DOCS = 2000  # documents whose words are samples of identifiers
PRIOR = 20.0
THRESHOLD = 0.7  # nats per transition


def _finds(pattern: str, kind: int, maybe: str, value: int, least: int) -> Column:
    """(start, kind, end, value) of the finds of ``pattern`` in ``text`` that have ``least``
    characters in group ``value``; ``maybe`` is a cheaper pattern that every find holds."""
    rx = F.lit(pattern)
    pieces = F.arrays_zip(
        F.split("text", pattern, -1).alias("gap"),
        F.regexp_extract_all("text", rx, F.lit(0)).alias("m"),
        F.regexp_extract_all("text", rx, F.lit(value)).alias("v"),
    )
    empty = "cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        find = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value"))
        return F.when(x["m"].isNull(), s).otherwise(
            F.struct(end.alias("at"), F.concat(s["found"], F.array(find)).alias("found")))

    zero = F.struct(F.lit(0).alias("at"), F.expr(empty).alias("found"))
    all_finds = F.aggregate(pieces, zero, add, lambda s: s["found"])
    kept = F.filter(all_finds, lambda f: F.length(f["value"]) >= least)
    return F.when(F.col("text").rlike(maybe), kept).otherwise(F.expr(empty))


def base_finds() -> Column:
    """The spans of the three patterns, by start, then kind."""
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in (
        "password", "passwd", "secret", "token", "api_?key"))
    assign = ASSIGN.replace("password|passwd|secret|token|api_?key", words)
    return F.array_sort(F.concat(
        _finds(assign, 0, f"(?:{words})[\"']?\\x20*[:=]", 2, LEAST_VALUE),
        _finds(ACCESS, 1, "AKIA", 0, 18), _finds(HEX, 2, HEX, 0, 16),
    ))


def _pairs(values: DataFrame) -> dict[str, int]:
    """How often each pair of neighbouring characters occurs in ``value``; the alphabet bounds
    what comes to the driver."""
    two = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))
    inside = "[" + ALPHABET.replace("-", "") + "-]"
    rows = (
        values.filter(F.length("value") > 1).select(F.explode(two).alias("pair"))
        .filter(F.col("pair").rlike(f"^{inside}{{2}}$")).groupBy("pair").count().collect()
    )
    return {r["pair"]: r["count"] for r in rows}


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def transitions(pairs: dict[str, int]) -> dict[str, float]:
    """p(b | a) as b after a: counts, and PRIOR more that fall to the classes of characters as the
    classes' own transitions say, evenly within a class."""
    members = [sum(_class(c) == k for c in ALPHABET) for k in range(4)]
    classes = [[1.0] * 4 for _ in range(4)]
    for pair, n in pairs.items():
        classes[_class(pair[0])][_class(pair[1])] += n
    out = {}
    for a in ALPHABET:
        row, total = classes[_class(a)], sum(pairs.get(a + b, 0) for b in ALPHABET)
        for b in ALPHABET:
            prior = row[_class(b)] / sum(row) / members[_class(b)]
            out[a + b] = (pairs.get(a + b, 0) + PRIOR * prior) / (total + PRIOR)
    return out


def log_ratios(random: dict[str, int], ordinary: dict[str, int]) -> list[float]:
    """log p(b | a, random) - log p(b | a, ordinary) by place of a and b, 0 being any other character."""
    p, q = transitions(random), transitions(ordinary)
    every = "\0" + ALPHABET
    return [round(math.log(p[a + b] / q[a + b]), 6) if "\0" not in a + b else 0.0 for a in every for b in every]


def _ratio(value: Column, ratios: list[float]) -> Column:
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1)))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0),
        lambda s, i: s + F.element_at(F.lit(ratios), place(i) * (len(ALPHABET) + 1) + place(i + 1) + 1),
    ) / (F.length(value) - 1)


def secrets(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, base, found`` for every row of ``documents`` (doc_id, text): the base spans and all
    spans, lists of (start, kind, end, value), by start, then kind (its place in KINDS).

    Positions are code points, the end exclusive. A null text is an empty one. A candidate
    that overlaps a base span is not looked at. Without base finds there is nothing to learn
    random strings from, and no span is added.
    """
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Only the spans are written down, not the texts.
    found = written(texts.select("doc_id", base_finds().alias("base"), _finds(CANDIDATE, 3, CANDIDATE, 0, 16).alias("other")), "spans")
    random = _pairs(found.select(F.explode("base.value").alias("value")))
    if not random:
        return found.select("doc_id", "base", F.col("base").alias("found"))
    share = min(1.0, sample_docs / max(found.count(), 1))
    sample = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit("identifiers")), F.lit(1_000_000)) < int(share * 1_000_000))
    words = sample.select(F.explode(F.split("text", r"[^A-Za-z0-9+/_=-]+")).alias("value"))
    ratios = log_ratios(random, _pairs(words.filter(~F.col("value").rlike("[0-9]"))))
    free = F.filter("other", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    added = F.filter(F.col("free"), lambda c: _ratio(c["value"], ratios) >= threshold)
    return found.withColumn("free", free).select(
        "doc_id", "base", F.array_sort(F.concat("base", added)).alias("found"))


def listed(spans: str) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

import math
import random
import re
from collections import Counter

import pytest

from surveytab.llm import quality as Q

from .helpers import WORD, documents, prose


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), n < 10 or 100 * len(covered) > 20 * n


@pytest.fixture(scope="module")
def rows():
    # Short words, so that trusted and other texts share them.
    good = [(i, " ".join(w[:4] for w in prose(i, 20 + i % 30).split()), None, None, 0) for i in range(60)]
    junk = [(100 + i, " | ".join(prose(i, 40, "bb").split()), None, None, 0) for i in range(15)]
    odd = ["a b c d e " * 8, "a b c d e f g a b c d e x y z p q r s t", "one\none\n\n \none", None, "", "\x0b\x0c#$ <é>\r\nü", "a a a a a a a a a a a a",
           prose(1, 30_000, "bb"), "a b c d e a b c d e", "p q r s t u v w x y z " * 2]
    return good + junk + [(200 + i, t, None, None, 0) for i, t in enumerate(odd)]


def test_faults_equal_brute_force(spark, rows):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    found = Q.quality(documents(spark, rows).repartition(2), labels).collect()
    assert len(found) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
        if r.doc_id < 100:
            assert r.kept
        if 100 <= r.doc_id < 200:
            assert not r.kept


def test_scores_equal_brute_force(spark, rows):
    """Buckets stand for words and pairs here: collisions are taken over from the operator's hashes."""
    rows = rows[:20]
    trusted = set(range(5))
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(0, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    table = documents(spark, rows)
    features = {r.doc_id: r.f for r in Q.with_hashes(table).select("doc_id", Q._features().alias("f")).collect()}
    raw = Counter(b for f in features.values() for b in f)
    target = Counter(b for i in trusted for b in features[i])
    p, q = sum(target.values()) + Q.BUCKETS, sum(raw.values()) + Q.BUCKETS
    for r in Q.quality(table, labels).collect():
        f = features[r.doc_id]
        expected = sum(math.log((target[b] + 1) / p) - math.log((raw[b] + 1) / q) for b in f) / len(f)
        assert len(f) == 2 * r.n_words - 1 and abs(r.score - expected) < 1e-5


def test_the_threshold_follows_the_trusted_documents_spread(spark):
    """Junk that differs in a few words only is refused, if trusted documents differ less."""
    words = [f"{w}{k}" for k, w in enumerate(prose(1, 200).split())]
    good = [" ".join(words[i:] + words[:i]) for i in range(120)]
    junk = [t.replace(words[150], f"{words[150]} |").replace(words[190], f"{words[190]} |") for t in good[60:]]
    rows = [(i, t, None, None, 0) for i, t in enumerate(good[:60] + junk)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    found = Q.quality(documents(spark, rows), labels).collect()
    assert all(r.kept for r in found if r.doc_id < 60)
    assert sum(r.kept for r in found if r.doc_id >= 60) <= 6


def test_edges(spark, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in Q.quality(documents(spark, rows[:2] + [(None, rows[0][1], None, None, 0)]), none).collect()}
    assert kept == {0: True, 1: True, None: True}
    assert Q.quality(documents(spark, []), none).collect() == []
    twice = Q.quality(documents(spark, [rows[0]] * 2).withColumnRenamed("lang", "score"), none.union(
        spark.createDataFrame([(0, 1, 0), (None, 1, None)], none.schema))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]

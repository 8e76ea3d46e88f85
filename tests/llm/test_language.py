import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveytab.llm import language as L

from .helpers import documents, prose


def learned_from(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 != 1


@pytest.fixture(scope="module")
def rows():
    return [(i, prose(i, 5 + i % 40, lang), lang, "s", 0) for i, lang in enumerate(["aa", "bb"] * 60)]


def test_languages_are_told_apart_on_held_out_documents(spark, rows):
    odd = [(900, None, "aa", None, 0), (901, "", None, None, 0), (902, "123 !?", "bb", None, 0),
           (903, "日本語の文章です。" * 200, "bb", None, 0), (904, prose(1, 90_000, "bb"), "aa", None, 0),
           (None, prose(2), None, None, 0), (5, rows[5][1], "bb", "s", 0)]
    odd = [o for o in odd if o[0] is None or o[0] in (5,) or not learned_from(o[0]) or o[1] in (None, "", "123 !?")] + [
        (i, "日本語の文章です。" * 200, None, None, 0) for i in range(950, 952)]
    found = L.predicted_languages(documents(spark, rows + odd)).collect()
    assert len(found) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in found}
    for doc_id, _, lang, _, _ in rows:
        r = by_id[doc_id]
        assert (r.lang_pred, r.held_out, r.rejected) == (lang, not learned_from(doc_id), False)
        assert 0 <= r.score <= 1
    for doc_id in (900, 901, 902):
        assert (by_id[doc_id].lang_pred, by_id[doc_id].score, by_id[doc_id].rejected) == ("und", 0.0, True)
    assert all(by_id[i].rejected and by_id[i].lang_pred in ("aa", "bb") for i in (950, 951))
    assert by_id[None].held_out is False and by_id[None].lang_pred == "aa"


def test_a_language_of_the_same_script_that_was_not_learned(spark):
    """Whatever a few mislabelled training documents do."""
    other = lambda i: " ".join("".join(random.Random(f"{i}-{k}").choices("la to vi plu esk ord".split(), k=3)) for k in range(60))
    rows = [(i, prose(i, 60, lang), lang, None, 0) for i, lang in enumerate(["aa", "bb"] * 300)]
    model = L.fit_languages(documents(spark, rows + [(9000, other(-1), "aa", None, 0)]), sample=100)
    assert sum(r for *_, r in model.predict([other(i) for i in range(200)])) >= 190
    assert sum(r for *_, r in model.predict([prose(5000 + i, 60, "aa") for i in range(200)])) <= 4


def test_names_that_clash_and_rows_that_pass_through(spark, rows):
    model = L.fit_languages(documents(spark, rows))
    table = documents(spark, rows[:4]).withColumn("score", F.lit("mine")).withColumn("rejected", F.lit(7))
    found, names = L.identify(table, model)
    assert names == ["lang_pred", "score_", "rejected_"]
    assert {(r.score, r.rejected, r.lang_pred) for r in found.collect()} == {("mine", 7, "aa"), ("mine", 7, "bb")}
    assert model.centroids.shape[0] == 2 * L.CENTROIDS
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)


def test_nothing_to_learn_from_and_empty_table(spark, rows):
    unlabelled = documents(spark, [(i, t, None, s, n) for i, t, _, s, n in rows[:3]])
    assert {(r.lang_pred, r.score) for r in L.predicted_languages(unlabelled).collect()} == {("und", 0.0)}
    assert L.predicted_languages(documents(spark, [])).collect() == []


def test_counts_of_a_text_do_not_depend_on_the_chunks(monkeypatch):
    text = prose(3, 300) + " ÄÖ 12 ß"
    whole = L.ngram_counts(text)
    assert L.ngram_counts("12 !") is None and L.ngram_counts(None) is None
    monkeypatch.setattr(L, "CHUNK", 10_000)
    assert np.array_equal(whole, L.ngram_counts(text))

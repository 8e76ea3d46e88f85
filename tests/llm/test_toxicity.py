import numpy as np
import pyarrow as pa
import pytest

from surveytab.llm import toxicity as X

from .helpers import documents, prose

BAD = ["gruk", "plom", "zeff", "wrax", "snod", "blit"]


def text(i, bad):
    words = prose(i, 30 + i % 50).split()
    for k in range(bad):
        words.insert((7 * k + i) % len(words), BAD[(i + k) % len(BAD)] + (",", "", "!!")[k % 3])
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    return [(i, text(i, (i % 5 == 0) * (1 + i % 4)), None, None, 0) for i in range(800)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 800) if i % 4 != 3], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def chain(spark, rows, labels):
    return X.fit_toxicity(documents(spark, rows), labels)


def test_held_out_documents(spark, rows, chain):
    found = X.toxicity(documents(spark, rows).repartition(3), chain).collect()
    assert len(found) == len(rows)
    held = [r for r in found if r.doc_id % 4 == 3]
    assert np.mean([r.toxic == (r.doc_id % 5 == 0) for r in held]) > 0.98
    severe = [r.p_severe > 0.5 for r in found if r.doc_id % 5 == 0 and r.doc_id % 4 == 3]
    assert np.mean(severe) > 0.8 and not any(r.p_severe > 0.5 for r in found if r.doc_id % 5)


def test_probabilities_equal_brute_force(rows, chain):
    texts = [rows[0][1], rows[3][1], "", "GRUK gruk plom"]
    got = np.concatenate(list(chain.probabilities(pa.array(texts))))
    for t, p in zip(texts, got):
        [(_, hashes, _)] = X.hashed_words(pa.array([t]), letters=True)
        held, odds = set(X._features(hashes).tolist()), []
        for link in chain.links:
            z = sum(w for f, w in zip(link.features, link.weights) if f in held) + sum(a * b for a, b in zip(odds, link.earlier)) + link.constant
            odds.append(min(max(z, -15), 15))
        assert np.allclose(p, 1 / (1 + np.exp(-np.array(odds))))


def test_logistic_regression_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x = (rng.random((300, 4)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 1] - 0.5)))).astype(float)
    w = X._logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (p - y) + X.RIDGE * w[:-1]).max() < 1e-4 and abs((p - y).sum()) < 1e-3


def test_later_links_use_the_earlier_odds(chain):
    assert [len(link.earlier) for link in chain.links] == [0, 1] and chain.links[1].earlier[0] > 0


def test_edges(spark, rows, labels, chain):
    odd = [(1, None, None, None, 0), (2, "", None, None, 0), (None, "gruk plom zeff", None, None, 0), (3, prose(1, 50_000) + " gruk plom zeff", None, None, 0)]
    got = {r.doc_id: r.toxic for r in X.toxicity(documents(spark, odd).withColumnRenamed("lang", "toxic"), chain).collect()}
    assert got == {1: False, 2: False, None: True, 3: True}
    assert X.toxicity(documents(spark, []), chain).collect() == []
    nothing = X.fit_toxicity(documents(spark, rows[:3]), labels.limit(0))
    assert {(r.p_toxic, r.toxic) for r in X.toxicity(documents(spark, rows[:3]), nothing).collect()} == {(0.0, False)}
    twice = labels.filter("doc_id < 40").union(labels.filter("doc_id < 40")).union(
        spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    assert len(X.training_documents(documents(spark, rows), twice)[0]) == 30

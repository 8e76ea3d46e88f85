from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from surveytab.llm import masked_lm as M
from surveytab.llm.text import hashed_words

from .helpers import documents, prose


@pytest.fixture(scope="module")
def rows():
    """Two words alternate, so the neighbours tell every word."""
    return [(i, " ".join(["tick", "tock"] * (10 + i % 20)), None, None, 0) for i in range(120)] + [
        (200 + i, prose(i, 30), None, None, 0) for i in range(40)]


@pytest.fixture(scope="module")
def network(spark, rows):
    return M.fit_network(documents(spark, rows))


def brute(network, text):
    """Word by word."""
    [(_, hashes, _)] = hashed_words(pa.array([text]))
    c = [int(network.class_of[b]) for b in M._buckets(hashes)]
    none, total = len(network.out_bias), 0.0
    for i in range(len(c)):
        h = network.bias.astype(float)
        for e, o in zip(network.around, (-2, -1, 1, 2)):
            h = h + e[c[i + o] if 0 <= i + o < len(c) else none]
        logits = np.tanh(h) @ network.out + network.out_bias
        total += logits[c[i]] - np.log(np.exp(logits).sum())
    return total


def test_sums_equal_brute_force(spark, rows, network):
    texts = [rows[0][1], rows[-1][1], "one", "tick tock", prose(3, 3000)]
    found = M.pseudo_likelihoods(documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]).coalesce(1), network)
    for r in found.collect():
        assert abs(r.log_likelihood - brute(network, texts[r.doc_id])) < 1e-3 * max(1, r.n_words)
        assert r.n_words == len(texts[r.doc_id].split()) and abs(r.score * r.n_words - r.log_likelihood) < 1e-9


def test_both_sides_are_learned(spark, network):
    texts = ["tick tock " * 12, "tock tick " * 12, "tick tick tock tock " * 6, prose(99, 24)]
    found = M.pseudo_likelihoods(documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), network)
    score = {r.doc_id: r.score for r in found.collect()}
    assert min(score[0], score[1]) > -0.3 > score[2] and score[0] > score[3] + 1


def test_edges_and_reruns(spark, rows, network):
    odd = [(1, None, None, None, 0), (2, "", None, None, 0), (3, " \n", None, None, 0), (None, "tick", None, None, 0), (4, "x" * 400_000, None, None, 0)]
    found = M.pseudo_likelihoods(documents(spark, odd).withColumnRenamed("lang", "score"), network).collect()
    got = {r.doc_id: (r.n_words, r.score is None) for r in found}
    assert got == {1: (0, True), 2: (0, True), 3: (0, True), None: (1, False), 4: (1, False)}
    assert M.pseudo_likelihoods(documents(spark, [])).collect() == []
    again = M.fit_network(documents(spark, rows).repartition(5))
    assert all(np.allclose(a, b) for a, b in ((again.around, network.around), (again.out, network.out)))


def test_every_word_counts_by_its_share_of_its_class(spark):
    """Whether a word's count is sent or joined, the sum is that of plain counts."""
    texts = [prose(i, 60) + f" id{i}" for i in range(60)]
    table = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    words = M.written(M.word_counts(table), "words")
    network = M.fit_network(table, words)
    counts = Counter(w for t in texts for w in t.split())
    class_of = {w: int(network.class_of[M._buckets(next(hashed_words(pa.array([w])))[1])][0]) for w in counts}
    totals = Counter()
    for w, n in counts.items():
        totals[class_of[w]] += n
    plain = {r.doc_id: r.log_likelihood for r in M.pseudo_likelihoods(table, network).collect()}
    for most in (1 << 20, 50, 0):
        known = M.vocabulary(words, network, most)
        assert (known.rare is None) == (most > 50) and len(known.words) <= most
        for r in M.pseudo_likelihoods(table, network, known).collect():
            more = sum(np.log(counts[w] / (totals[class_of[w]] + 1)) for w in texts[r.doc_id].split())
            assert abs(r.log_likelihood - plain[r.doc_id] - more) < 1e-3
    own = {r.doc_id: r.log_likelihood for r in M.pseudo_likelihoods(table).collect()}
    assert all(abs(own[r.doc_id] - r.log_likelihood) < 1e-3 for r in M.pseudo_likelihoods(table, network, known).collect())


def test_all_documents_are_trained_on(spark, rows, monkeypatch):
    """A change in any one document changes the network; tasks make no difference."""
    monkeypatch.setattr(M, "GROUP_WORDS", 1000)
    table = documents(spark, rows)
    network = M.fit_network(table)
    again = M.fit_network(table.repartition(5))
    assert np.allclose(network.around, again.around, atol=1e-5) and np.allclose(network.out, again.out, atol=1e-5)
    words = M.written(M.word_counts(table), "words")
    for doc_id in (0, 57, 230):
        other = [(i, " ".join(sorted(t.split())) if i == doc_id else t, None, None, 0) for i, t, *_ in rows]
        assert not np.allclose(M.fit_network(documents(spark, other), words).around, network.around, atol=1e-5)


@pytest.mark.parametrize("scale", [1, 400])
def test_large_and_small_logits(network, monkeypatch, scale):
    """The largest logit of a row is taken off only where one may be too large; it makes no difference."""
    wide = M.replace(network, out=network.out * np.float32(scale))
    words = np.concatenate([h for _, h, _ in hashed_words(pa.array([prose(3, 700) + " tick tock" * 200]))])
    ids, at = wide.padded(words, np.array([0, len(words)]))
    logits = wide.hidden(ids, at) @ np.vstack([wide.out, wide.out_bias])
    assert (M._exponentials(logits, np.ones(logits.shape[1], np.float32)) is None) == (scale > 1)
    found, trained = wide.log_probabilities(ids, at), M._flat(M.train(wide, ids, at))
    assert np.isfinite(found).all() and np.isfinite(trained).all()
    monkeypatch.setattr(M, "MOST_SUM", 0)
    assert np.allclose(found, wide.log_probabilities(ids, at), atol=1e-4)
    assert np.allclose(trained, M._flat(M.train(wide, ids, at)), atol=2e-3)
    h = np.tanh(wide.bias.astype(float) + sum(e[ids[at + o]].astype(float) for e, o in zip(wide.around, M.OFFSETS)))
    logits = h @ wide.out + wide.out_bias
    logits -= logits.max(axis=1, keepdims=True)
    expected = logits[np.arange(len(at)), ids[at]] - np.log(np.exp(logits).sum(axis=1))
    assert np.allclose(found, expected, atol=1e-2 if scale > 1 else 1e-4)


def test_a_task_trains_its_groups_one_by_one_and_adds_them_up(network):
    """Also where a group's rows come in several batches; only one row leaves a task."""
    class Shared:
        value = network

    rng = np.random.Generator(np.random.PCG64(5))
    rows = [(g, i, rng.integers(0, 192, 30 + 7 * i, np.int16)) for g in (3, 8, 9) for i in range(4)]
    expected, words = 0, 0
    for g in (3, 8, 9):
        docs = [c for h, _, c in rows if h == g]
        firsts = np.cumsum([0, *map(len, docs)])
        ids = np.full(firsts[-1] + M.SIDE * (len(docs) + 1), 192)
        at = np.concatenate([np.arange(a, b) + M.SIDE * (i + 1) for i, (a, b) in enumerate(zip(firsts[:-1], firsts[1:]))])
        ids[at] = np.concatenate(docs)
        expected = expected + M._flat(M.train(network, ids, at, 1)).astype(float) * firsts[-1]
        words += firsts[-1]
    table = pa.RecordBatch.from_pylist([{"group": g, "order": i, "ids": c.tobytes()} for g, i, c in rows])
    for size in (1, 3, 5, 12):
        [found] = M._train_groups(Shared, 1)([table.slice(0, 0), *(table.slice(s, size) for s in range(0, 12, size))])
        assert found.column("words").to_pylist() == [words]
        assert np.array_equal(found.column("weights")[0].values.to_numpy(), expected)
    assert list(M._train_groups(Shared, 1)([table.slice(0, 0)])) == []


def test_words_that_share_a_bucket_and_words_that_occur_once(spark, network):
    top = np.uint64(1 << (64 - M.BUCKET_BITS))
    words = np.array([0, 5, 6, 7, top, 3 * top - np.uint64(1), 3 * top, np.uint64(2**64 - 2), np.uint64(2**64 - 1)], np.uint64)
    known = M.Vocabulary(words, np.arange(1, 10, dtype=np.float32), np.zeros(192))
    asked = np.concatenate([words, words[:-1] + np.uint64(1), words[1:] - np.uint64(1), np.array([2 * top], np.uint64)])
    found, missing = known.of(asked, np.zeros(len(asked), int))
    at = {int(w): i + 1 for i, w in enumerate(words)}
    assert found.tolist() == [at.get(int(w), 0) for w in asked] and missing.tolist() == [int(w) not in at for w in asked]
    # log 1 is 0: what occurs once needs no join.
    counts = M.written(spark.createDataFrame([(i, 1 + i % 3) for i in range(30)], "word bigint, n bigint"), "words")
    hashed = M.replace(network, class_of=np.full(1 << M.BUCKET_BITS, M.FREQUENT, np.int16))
    assert sorted(r.n for r in M.vocabulary(counts, hashed, 0).rare.collect()) == [2] * 10 + [3] * 10

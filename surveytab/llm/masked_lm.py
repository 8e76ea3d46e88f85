"""Scoring documents by masked pseudo-likelihood with a small window network.

A document's score is the sum, over all its words, of the log probability of the word given the words
around it on both sides: log p(class | words around) + log p(word | class). The network gives the
first. It adds an embedding for each of the two words before and after, takes tanh, and gives a softmax
over word classes: the most frequent words of the whole corpus each have their own, and the others
are hashed to a few dozen. The second is the word's share of its class, from the counts of all
words of the corpus, so the vocabulary grows with the input.

The network is trained in numpy on all documents, from an output bias set to the log frequencies of
the classes. Documents are dealt by hash to groups of some ten thousand words and groups to
rounds; in a round every group goes on from the same weights by itself, and their results are averaged,
weighted by words. Which task trains a group makes no difference. Texts are hashed once, to class numbers
of two bytes a word, and written in the order of the rounds; a round reads its own. Tasks grow in number
with the groups; a task trains its groups one after another and gives the sum of their weights. Sums are added up
in Spark, so the driver gets the square root of the tasks' number of rows.

Scoring is one pass over the texts, a few thousand words at a time. The counts of the 131 072 most
frequent words are sent to all executors; rarer words are joined, which no frequent word makes uneven, but for
those that occur once, whose log count is 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written
from .text import hashed_words

BUCKET_BITS = 20
FREQUENT, HASHED = 128, 64  # classes
SIDE = 2  # words looked at on each side
HIDDEN = 32
GROUP_WORDS = 64_000  # about so many are trained on in one go
ROUNDS = 8  # at most; with fewer groups, as many
EPOCHS, BATCH, RATE = 2, 512, 0.004  # epochs of a corpus that is one group; larger ones are gone through once
GROUPS_PER_TASK, MOST_TASKS = 4, 8192  # trained in one go by a task; tasks of a round at most
MOST_WORDS = 1 << 17  # words sent to all executors with their counts (1.6 MB)
AT_ONCE = 1024
LEAST_SUM, MOST_SUM = 1e-25, 1e25  # of exponentials that are used as they are
_U = np.uint64


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - BUCKET_BITS)).astype(np.int64)


def word_counts(documents: DataFrame) -> DataFrame:
    """``word, n``: how often each word (its hash) occurs in all texts."""
    def run(batches):
        def summed(words, n):
            words, at = np.unique(np.concatenate(words), return_inverse=True)
            return words, np.bincount(at, np.concatenate(n), len(words)).astype(np.int64)

        words, n, waiting = [], [], 0
        for batch in batches:
            for _, hashes, _ in hashed_words(batch.column(0)):
                some, times = np.unique(hashes, return_counts=True)
                words.append(some)
                n.append(times)
                waiting += len(some)
                if waiting > 1_000_000:
                    words, n = ([x] for x in summed(words, n))
                    waiting = len(words[0])
                    if waiting > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(words[0].view(np.int64)), pa.array(n[0])], ["word", "n"])
                        words, n, waiting = [], [], 0
        if words:
            some, times = summed(words, n)
            yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(times)], ["word", "n"])

    return documents.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _bucket():
    return F.shiftrightunsigned("word", 64 - BUCKET_BITS)


@dataclass
class WindowNetwork:
    class_of: np.ndarray  # of each bucket
    around: np.ndarray  # (2 * SIDE, classes + 1, HIDDEN); the last class is no word
    bias: np.ndarray
    out: np.ndarray  # (HIDDEN, classes)
    out_bias: np.ndarray

    def padded(self, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes with SIDE empty places before each document and at the end, and where the words are."""
        n, none = len(hashes), len(self.out_bias)
        at = np.arange(n) + SIDE * (1 + np.repeat(np.arange(len(firsts) - 1), np.diff(firsts)))
        ids = np.full(n + SIDE * len(firsts), none, np.int64)
        ids[at] = self.class_of[_buckets(hashes)]
        return ids, at

    def hidden(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The hidden units, and one that is always 1."""
        h = np.ones((len(at), len(self.bias) + 1), np.float32)
        np.tanh(_added([e.take(ids.take(at + o), axis=0) for e, o in zip(self.around, OFFSETS)], self.bias), out=h[:, :-1])
        return h

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.float64)
        weights = np.vstack([self.out, self.out_bias]).astype(np.float32)
        classes = len(self.out_bias)
        ones, rows, space = np.ones(classes, np.float32), np.arange(AT_ONCE) * classes, np.empty((AT_ONCE, classes), np.float32)
        for s in range(0, len(at), AT_ONCE):
            here = at[s : s + AT_ONCE]
            h, places = self.hidden(ids, here), rows[: len(here)] + ids[here]
            logits = np.matmul(h, weights, out=space[: len(here)])
            right, sums = logits.take(places), _exponentials(logits, ones)
            if sums is None:
                np.matmul(h, weights, out=logits)
                logits -= logits.max(axis=1, keepdims=True)
                right, sums = logits.take(places), np.exp(logits, out=logits) @ ones
            out[s : s + AT_ONCE] = right - np.log(sums)
        return out


OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]


def _added(parts: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """The sum of all parts and the bias, in the place of the first part."""
    total = parts[0]
    for part in [*parts[1:], bias]:
        total += part
    return total


def _exponentials(logits: np.ndarray, ones: np.ndarray) -> np.ndarray | None:
    """Puts exponentials in the place of the logits and returns their sums by row; None if one is near the limits of
    32 bits, so that the largest logit of each row must be taken off first."""
    with np.errstate(over="ignore", invalid="ignore"):
        sums = np.exp(logits, out=logits) @ ones
    return sums if sums.min() > LEAST_SUM and sums.max() < MOST_SUM else None


def train(network: WindowNetwork, ids: np.ndarray, at: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> WindowNetwork:
    """A network trained on from ``network``, by Adam over shuffled windows; deterministic. All weights
    lie in one array, the output bias below the output weights, so that a hidden unit that is always 1 takes it along."""
    rng = np.random.Generator(np.random.PCG64(seed))
    flat = _flat(network)
    gradient, first, second, spare = (np.zeros_like(flat) for _ in range(4))
    trained, by_weight = _unflat(flat, network), _unflat(gradient, network)
    classes, units = len(network.out_bias), len(network.bias)
    out = flat[-(units + 1) * classes :].reshape(units + 1, classes)
    d_around, d_out = by_weight.around.reshape(len(OFFSETS), -1), gradient[-(units + 1) * classes :].reshape(units + 1, classes)
    places = np.arange((classes + 1) * units).reshape(classes + 1, units)
    ones, rows, step = np.ones(max(classes, BATCH), np.float32), np.arange(BATCH) * classes, 0
    # Arrays of a batch are made once.
    hs, shared, ps = (np.ones((BATCH, k), np.float32) for k in (units + 1, units + 1, classes))
    backs, slopes = np.empty((BATCH, units), np.float32), np.empty((BATCH, units), np.float32)
    wides, ats = np.empty((BATCH, units)), np.empty((BATCH, units), places.dtype)
    for _ in range(epochs):
        order = at[rng.permutation(len(at))]
        windows = [ids.take(order + o).astype(np.int16) for o in (0, *OFFSETS)]
        for s in range(0, len(at), BATCH):
            here, *near = (x[s : s + BATCH].astype(np.intp) for x in windows)
            n = len(here)
            h, p, back, slope = hs[:n], ps[:n], backs[:n], slopes[:n]
            np.tanh(_added([e.take(x, axis=0) for e, x in zip(trained.around, near)], trained.bias), out=h[:, :units])
            sums = _exponentials(np.matmul(h, out, out=p), ones[:classes])
            if sums is None:
                np.matmul(h, out, out=p)
                p -= p.max(axis=1, keepdims=True)
                sums = np.exp(p, out=p) @ ones[:classes]
            # Rows are divided by their sums (and n) where they are short.
            share = (1 / (sums * np.float32(n)))[:, None]
            p.ravel()[rows[:n] + here] -= sums
            np.matmul(p, out[:units].T, out=back)
            back *= share
            np.square(h[:, :units], out=slope)
            back *= np.subtract(np.float32(1), slope, out=slope)
            wides[:n] = back
            wide = wides[:n].ravel()
            for d, x in zip(d_around, near):
                d[:] = np.bincount(places.take(x, axis=0, out=ats[:n], mode="clip").ravel(), wide, len(d))
            np.matmul(ones[:n], back, out=by_weight.bias)
            np.matmul(np.multiply(h, share, out=shared[:n]).T, p, out=d_out)
            step += 1
            np.multiply(gradient, np.float32(0.1), out=spare)
            first *= np.float32(0.9)
            first += spare
            np.multiply(gradient, gradient, out=spare)
            spare *= np.float32(0.001)
            second *= np.float32(0.999)
            second += spare
            np.sqrt(np.multiply(second, np.float32(1 / (1 - 0.999**step)), out=spare), out=spare)
            spare += np.float32(1e-8)
            np.divide(first, spare, out=spare)
            spare *= np.float32(RATE / (1 - 0.9**step))
            flat -= spare
    return trained


def _class_totals(words: DataFrame, frequent: list[int]) -> np.ndarray:
    """How many words of each class are in the corpus."""
    bucket = F.col("bucket")
    rest = F.when(bucket.isin(frequent), bucket).otherwise(-1 - bucket % HASHED)
    sums = words.withColumn("bucket", _bucket()).groupBy(rest.alias("c")).agg(F.sum("n").alias("n")).collect()
    sums = {r["c"]: r["n"] for r in sums}
    return np.array([*(sums[b] for b in frequent), *[0] * (FREQUENT - len(frequent)), *(sums.get(-1 - k, 0) for k in range(HASHED))], float)


def _weights(network: WindowNetwork) -> list[np.ndarray]:
    return [network.around, network.bias, network.out, network.out_bias]


def _flat(network: WindowNetwork) -> np.ndarray:
    """A copy of all weights in one array."""
    return np.concatenate([w.ravel() for w in _weights(network)])


def _unflat(flat: np.ndarray, like: WindowNetwork) -> WindowNetwork:
    """A network whose weights are views of ``flat``."""
    ends = np.cumsum([w.size for w in _weights(like)])[:-1]
    return WindowNetwork(like.class_of, *[p.reshape(w.shape) for p, w in zip(np.split(flat, ends), _weights(like))])


def _train_groups(shared, epochs: int):
    """For the rows of a task, ``group, order, ids`` in that order: their words, and the sum over their groups of the
    network's weights after a group's documents, times its words. One group at a time is held."""
    def trained(docs: list[bytes]) -> tuple[int, np.ndarray]:
        network = shared.value
        found, none = np.frombuffer(b"".join(docs), np.int16), len(network.out_bias)
        words, lengths = len(found), np.array([len(x) for x in docs]) // found.itemsize
        at = np.arange(words) + SIDE * (1 + np.repeat(np.arange(len(docs)), lengths))
        ids = np.full(words + SIDE * (len(docs) + 1), none, np.int64)
        ids[at] = found
        return words, _flat(train(network, ids, at, epochs)).astype(np.float64) * words

    def run(batches):
        words, total, group, docs = 0, 0.0, None, []
        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if docs and groups[a] != group:
                    n, weights = trained(docs)
                    words, total, docs = words + n, total + weights, []
                group = groups[a]
                docs += batch.column(2).slice(a, b - a).to_pylist()
        if docs:
            n, weights = trained(docs)
            words, total = words + n, total + weights
        if words:
            yield _weighted(words, total)

    return run


def _weighted(words: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([words]), pa.array([weights], pa.list_(pa.float64()))], ["words", "weights"])


def _summed_weights(batches):
    """One row a task: the sums of its rows."""
    words, total = 0, 0.0
    for batch in batches:
        for n, weights in zip(batch.column(0).to_pylist(), batch.column(1)):
            words += n
            total = total + weights.values.to_numpy()
    if words:
        yield _weighted(words, total)


def fit_network(documents: DataFrame, words: DataFrame | None = None) -> WindowNetwork:
    """A network for ``documents`` (doc_id, text), trained on all of them; ``words`` are their
    ``word_counts``, if known."""
    small_batches(documents.sparkSession)
    words = written(word_counts(documents), "words") if words is None else words
    buckets = words.groupBy(_bucket().alias("bucket")).agg(F.sum("n").alias("n"))
    frequent = [r["bucket"] for r in buckets.orderBy(F.desc("n"), "bucket").limit(FREQUENT).collect()]
    class_of = FREQUENT + np.arange(1 << BUCKET_BITS) % HASHED
    class_of[frequent] = np.arange(len(frequent))
    class_of = class_of.astype(np.int16)
    seen = _class_totals(words, frequent)
    rng = np.random.Generator(np.random.PCG64(7))
    classes = FREQUENT + HASHED
    network = WindowNetwork(
        class_of,
        rng.normal(0, 0.1, (2 * SIDE, classes + 1, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
        rng.normal(0, 0.1, (HIDDEN, classes)).astype(np.float32),
        np.log((seen + 1) / (seen + 1).sum()).astype(np.float32),
    )
    groups = max(1, round(seen.sum() / GROUP_WORDS))
    rounds = min(ROUNDS, groups)
    tasks = min(-(-groups // (rounds * GROUPS_PER_TASK)), MOST_TASKS)
    order = F.xxhash64("doc_id", "text", F.lit("language model"))
    group = F.pmod(order, F.lit(groups))
    dealt = documents.select("text", order.alias("order"), group.alias("group"), F.pmod(group, F.lit(rounds)).alias("round"))
    spark = documents.sparkSession
    classes_of = spark.sparkContext.broadcast(class_of)

    def run(batches):
        for batch in batches:
            for row, hashes, firsts in hashed_words(batch.column(0)):
                found = classes_of.value[_buckets(hashes)]
                ids = [found[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:])]
                part = batch.slice(row, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in (3, 2, 1)), pa.array(ids, pa.binary())], ["round", "group", "order", "ids"])

    classed = dealt.mapInArrow(run, "round bigint, group bigint, order bigint, ids binary").filter("length(ids) > 0")
    classed = written(classed.sortWithinPartitions("round"), "classes")  # a round reads its own pages
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(replace(network, class_of=None))
        sums = "words bigint, weights array<double>"
        found = (
            classed.filter(F.col("round") == k).select("group", "order", "ids")
            .repartition(tasks, "group").sortWithinPartitions("group", "order", "ids")
            .mapInArrow(_train_groups(shared, EPOCHS if groups == 1 else 1), sums).repartition(math.isqrt(tasks) + 1).mapInArrow(_summed_weights, sums)
        )
        n, total = 0, 0.0
        for row in found.collect():
            n, total = n + row["words"], total + np.array(row["weights"])
        shared.destroy()
        if n:
            network = _unflat((total / n).astype(np.float32), network)
    classes_of.destroy()
    return network


@dataclass
class Vocabulary:
    """log p(word | class), as counts. Of a class's words, one more than were seen is left for
    words that were not."""
    words: np.ndarray  # sorted hashes
    log_n: np.ndarray  # of them
    log_total: np.ndarray  # of each class
    rare: DataFrame | None = None  # word, n of the others that were seen more than once
    firsts: np.ndarray | None = None  # of the words of each bucket, made where it is needed

    def of(self, hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log p(word | class), without log n for words that are not here, and which are not."""
        if not len(self.words):
            return -self.log_total[classes], np.ones(len(hashes), bool)
        if self.firsts is None:
            self.firsts = np.cumsum(np.bincount(_buckets(self.words) + 1, minlength=(1 << BUCKET_BITS) + 1)).astype(np.int32)
        buckets = _buckets(hashes)
        at, ends = self.firsts.take(buckets), self.firsts.take(buckets + 1)
        here = self.words.take(at, mode="clip") == hashes
        others = np.flatnonzero(~here & (at + 1 < ends))  # few: a bucket seldom has more than one word
        while len(others):
            at[others] += 1
            here[others] = self.words[at[others]] == hashes[others]
            others = others[~here[others] & (at[others] + 1 < ends[others])]
        return np.where(here, self.log_n.take(at, mode="clip"), 0.0) - self.log_total[classes], ~here


def vocabulary(words: DataFrame, network: WindowNetwork, most: int = MOST_WORDS) -> Vocabulary:
    """The vocabulary of ``words`` (``word_counts``, written), the most frequent ``most`` at hand."""
    least, n = 1, 0
    for row in words.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        n += row["count"]
        if n > most:
            least = row["n"] + 1
            break
    top = words.filter(F.col("n") >= least).toPandas()
    hashes = top["word"].to_numpy(np.int64).view(_U)
    order = np.argsort(hashes)
    frequent = np.flatnonzero(network.class_of < FREQUENT)
    frequent = frequent[np.argsort(network.class_of[frequent])].tolist()
    return Vocabulary(
        hashes[order], np.log(top["n"].to_numpy(np.float64))[order].astype(np.float32),
        np.log(_class_totals(words, frequent) + 1),
        words.filter((F.col("n") < least) & (F.col("n") > 1)) if least > 1 else None)


def pseudo_likelihoods(
    documents: DataFrame, network: WindowNetwork | None = None, known: Vocabulary | None = None
) -> DataFrame:
    """``doc_id, n_words, log_likelihood, score`` for every row of ``documents`` (doc_id, text):
    the summed log probabilities of all words, and their mean. Without a network, both it and the
    vocabulary are the documents' own; a network without a vocabulary gives the probabilities of the
    words' classes alone. A null text or one without words has 0 words, 0.0 and a null score. Other
    columns are ignored; rows are independent."""
    small_batches(documents.sparkSession)
    documents = documents.select("doc_id", "text")
    if network is None:
        words = written(word_counts(documents), "words")
        network = fit_network(documents, words)
        known = vocabulary(words, network) if known is None else known
    rare = known.rare if known is not None else None
    lists = rare is not None  # of the words that are to be joined
    known = replace(known, rare=None) if known is not None else None
    shared = documents.sparkSession.sparkContext.broadcast((network, known))

    def run(batches):
        network, known = shared.value
        for batch in batches:
            ids, n, sums, more = batch.column(0), [], [], []
            for _, hashes, firsts in hashed_words(batch.column(1)):
                classes, at = network.padded(hashes, firsts)
                each = network.log_probabilities(classes, at)
                if known is not None:
                    words, missing = known.of(hashes, classes[at])
                    each = each + words
                    if lists:
                        more += [hashes[a:b][missing[a:b]].view(np.int64) for a, b in zip(firsts[:-1], firsts[1:])]
                total = np.concatenate([[0.0], np.cumsum(each)])
                n.append(np.diff(firsts))
                sums.append(total[firsts[1:]] - total[firsts[:-1]])
            n, sums = (np.concatenate([*x, np.zeros(0)]) for x in (n, sums))
            columns = [ids, pa.array(n.astype(np.int64)), pa.array(sums.astype(np.float64))]
            if lists:
                columns.append(pa.array(more, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "log_likelihood", "rare"][: len(columns)])

    found = documents.mapInArrow(run, "doc_id bigint, n_words bigint, log_likelihood double" + (", rare array<bigint>" if lists else ""))
    if lists:
        found = written(found.withColumn("row", F.monotonically_increasing_id()), "found")
        joined = (
            found.select("row", F.explode("rare").alias("word")).join(rare, "word", "left")
            .groupBy("row").agg(F.sum(F.log(F.coalesce("n", F.lit(1)))).alias("more"))
        )
        found = found.join(joined, "row", "left").select(
            "doc_id", "n_words", (F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))
    return found.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))

"""Runs of repeated words, found in a grammar of each text.

A run is a stretch of consecutive words with smallest period q (words q apart are alike), of at least
``LEAST`` words and two periods, that no neighbouring word extends.

1. Re-Pair: the most frequent pair of neighbouring symbols of a text becomes a new symbol, again and
   again until no pair occurs twice. All texts of a block are worked on at once, and in a round every
   pair gives way that is at least as frequent as those it overlaps with. A pair that occurs once does
   so forever, so the work shrinks with what is left to replace. What remains of a text is
   halved into a balanced tree.
2. Once per symbol: the runs that cross the boundary between its two parts. A run that crosses it holds a
   whole period on one side, so two words q apart beside the boundary are compared for every q, and how
   far they agree to both sides is told by polynomial hashes in a binary search. Six words in a row
   must agree, so most q are ruled out by the three words next to the boundary.
3. These runs are moved to every place where the symbol was put in, and intervals of one period that share
   a period's words become one. A run lies whole in the smallest symbol that holds it, so each
   maximal run is there; of equal intervals the one of smallest period is the run.
4. Every run is compared word by word at last; if a hash was wrong, the block is done again with another.

Memory goes with the longest text, not with the table. Texts are independent of each other: no
shuffle, and a lost task is run again by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import _words
from .store import fresh, small_batches
from .text import hashed_words, mixed, utf8

LEAST = 12  # words of a run
_NEAR = LEAST // 4  # words beside a boundary of which one side or the other must agree
_BLOCK_WORDS = 1 << 18
_AT_ONCE = 1 << 21  # comparisons worked on at once
_PRIMES = (2147483647, 2147483629)
_U = np.uint64


def _ids(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Word numbers that no two texts share."""
    text = np.repeat(np.arange(len(firsts) - 1, dtype=_U), np.diff(firsts))
    return np.unique(mixed(hashes + mixed(text + _U(1))), return_inverse=True)[1].astype(np.int64)


class Nodes:
    """Occurrences of symbols with two parts: symbol, first word, words of the left part, of both."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, symbol, start, left, whole) -> None:
        self.parts.append((symbol, start, left, whole))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate([*c, np.zeros(0, np.int64)]) for c in zip(*self.parts)) if self.parts else (
            tuple(np.zeros(0, np.int64) for _ in range(4)))


def _choose(rank: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Which pairs give way: ranked no lower than the pairs they overlap with; of overlapping equal ones
    every other. ``linked`` tells whether the next pair overlaps."""
    left = np.full(len(rank), -1)
    left[1:] = np.where(linked[:-1], rank[:-1], -1)
    right = np.full(len(rank), -1)
    right[:-1] = np.where(linked[:-1], rank[1:], -1)
    begins = np.flatnonzero(left != rank)
    index = np.arange(len(rank)) - np.repeat(begins, np.diff(begins, append=len(rank)))
    return (rank >= left) & (rank >= right) & (index % 2 == 0)


def re_pair(ids: np.ndarray, firsts: np.ndarray) -> tuple[Nodes, np.ndarray]:
    """The occurrences of all symbols, and for each word whether a symbol of what remains starts there."""
    n = len(ids)
    wide = 2 * n + 2  # more than there can be symbols
    nodes, starts = Nodes(), np.ones(n, bool)
    end = np.repeat(firsts[1:], np.diff(firsts))  # of the text that a word is in
    symbol, at, size = ids.copy(), np.arange(n), np.ones(n, np.int64)
    follows = np.zeros(n, bool)  # a symbol's next one stands behind it, and their pair may be frequent
    follows[:-1] = at[:-1] + 1 < end[:-1]
    rule_keys, rule_symbols, fresh_symbol = np.zeros(0, np.int64), np.zeros(0, np.int64), n
    while True:
        pair = np.flatnonzero(follows)
        if not len(pair):
            return nodes, starts
        keys = symbol[pair] * wide + symbol[pair + 1]
        known, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
        often = counts[which] > 1
        follows[pair[~often]] = False
        pair, which = pair[often], which[often]
        if not len(pair):
            return nodes, starts
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((mixed(known.view(_U)), counts))] = np.arange(len(known))
        chosen = _choose(rank[which], np.append(np.diff(pair) == 1, False))
        pair, which = pair[chosen], which[chosen]
        used = np.unique(which)
        place = np.searchsorted(rule_keys, known[used])
        found = np.zeros(len(used), bool)
        inside = place < len(rule_keys)
        found[inside] = rule_keys[place[inside]] == known[used[inside]]
        names = np.empty(len(used), np.int64)
        names[found] = rule_symbols[place[found]]
        more = int((~found).sum())
        names[~found] = np.arange(fresh_symbol, fresh_symbol + more)
        fresh_symbol += more
        rule_keys = np.insert(rule_keys, place[~found], known[used[~found]])
        rule_symbols = np.insert(rule_symbols, place[~found], names[~found])
        new = names[np.searchsorted(used, which)]
        whole = size[pair] + size[pair + 1]
        nodes.add(new, at[pair], size[pair], whole)
        starts[at[pair + 1]] = False
        symbol[pair], size[pair] = new, whole
        follows[pair] = follows[pair + 1]
        keep = np.ones(len(symbol), bool)
        keep[pair + 1] = False
        # Symbols without a pair to either side are done with.
        kept = np.flatnonzero(keep)
        near = follows[kept]
        near[1:] |= near[:-1].copy()
        kept = kept[near]
        symbol, at, size, follows = symbol[kept], at[kept], size[kept], follows[kept]


def _halve(nodes: Nodes, starts: np.ndarray, firsts: np.ndarray, symbol: int) -> None:
    """A balanced tree over what remains of each text, its nodes added to ``nodes``."""
    at = np.flatnonzero(starts)
    while True:
        text = np.searchsorted(firsts, at, "right") - 1
        index = np.arange(len(at)) - np.searchsorted(at, firsts)[text]
        stop = np.append(at[1:], firsts[-1])
        stop = np.minimum(stop, firsts[text + 1])
        second = index % 2 == 1
        if not second.any():
            return
        right = np.flatnonzero(second)
        left = right - 1
        nodes.add(np.arange(symbol, symbol + len(left)), at[left], at[right] - at[left], stop[right] - at[left])
        symbol += len(left)
        at = at[~second]


class Prefixes:
    """Polynomial hashes of all prefixes of ``ids``, to compare any two of its stretches."""

    def __init__(self, ids: np.ndarray, seed: int) -> None:
        self.tables = []
        for i, p in enumerate(_PRIMES):
            base, prime = _U(1_000_003 + 7919 * (2 * seed + i)), _U(p)
            power = np.ones(1, _U)
            step = base
            while len(power) < len(ids) + 1:
                power = np.concatenate([power, power * step % prime])
                step = step * step % prime
            value = mixed(ids.astype(_U) + _U(seed + 1)) % prime
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(value * power[: len(ids)] % prime) % prime])
            self.tables.append((prime, power, sums))

    def alike(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Are ``length`` words from i and from j alike (i < j)?"""
        same = np.ones(len(i), bool)
        for prime, power, sums in self.tables:
            a = (sums[i + length] + prime - sums[i]) % prime
            b = (sums[j + length] + prime - sums[j]) % prime
            same &= a * power[j - i] % prime == b
        return same

    def agree(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from i and from j on are alike, ``most`` at most; with ``back``, words before them."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo] + 1) // 2
            shift = middle if back else 0
            same = self.alike(i[todo] - shift, j[todo] - shift, middle)
            low[todo[same]] = middle[same]
            high[todo[~same]] = middle[~same] - 1
            todo = todo[low[todo] < high[todo]]
        return low


def _numbered(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): owners 0 0 1 1 1 and numbers 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _pieces(counts: np.ndarray) -> Iterator[slice]:
    """Slices of ``counts`` that add up to about _AT_ONCE."""
    total, begin = np.cumsum(counts), 0
    while begin < len(counts):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + _AT_ONCE, "right")))
        yield slice(begin, end)
        begin = end


def crossing(ids: np.ndarray, prefixes: Prefixes, start, left, whole) -> tuple[np.ndarray, ...]:
    """(node, first word, end, period) of the runs across the boundary of each node, inside the node. They may
    be repeated, with multiples of their period too."""
    n = len(ids)
    near = np.zeros(n + 2 * _NEAR, _U)  # of the words from a place on; the ends agree with nothing
    near[:_NEAR] = mixed(np.arange(_NEAR, dtype=_U) + _U(1 << 62))
    near[n:] = mixed(np.arange(len(near) - n, dtype=_U) + _U(1 << 61))
    if n >= _NEAR:
        head = np.zeros(n - _NEAR + 1, _U)
        for k in range(_NEAR):
            head = mixed(head + ids[k : n - _NEAR + 1 + k].astype(_U) + _U(1))
        near[_NEAR : n + 1] = head
    boundary, stop = start + left, start + whole
    out = []
    for on_left in (False, True):
        counts = np.minimum(left if on_left else whole - left, whole // 2)
        for piece in _pieces(counts):
            owner, q = _numbered(counts[piece])
            owner, q = owner + piece.start, q + 1
            i = boundary[owner] - q if on_left else boundary[owner]
            # near is shifted by _NEAR: near[x] are the words before x, near[x + _NEAR] those from x on.
            hit = (near[i + _NEAR] == near[i + q + _NEAR]) | (near[i] == near[i + q])
            owner, q, i = owner[hit], q[hit], i[hit]
            ahead = prefixes.agree(i, i + q, stop[owner] - i - q)
            behind = prefixes.agree(i, i + q, i - start[owner], back=True)
            long = ahead + behind + q >= np.maximum(LEAST, 2 * q)
            owner, q, i, ahead, behind = (x[long] for x in (owner, q, i, ahead, behind))
            out.append((owner, i - behind, i + q + ahead, q))
    return tuple(np.concatenate([*c, np.zeros(0, np.int64)]) for c in zip(*out)) if out else (
        tuple(np.zeros(0, np.int64) for _ in range(4)))


def _shortest(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows that are alike but for their last column become the one with the least."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns[:-1]:
        new[1:] |= c[1:] != c[:-1]
    return tuple(c[new] for c in columns)


def merged(first: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """The maximal runs of intervals in which words a period apart are alike, by first word and period."""
    order = np.lexsort((first, period))
    first, end, period = first[order], end[order], period[order]
    if not len(first):
        return first, end, period
    group = np.cumsum(np.append(False, period[1:] != period[:-1]))
    room = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * room) - group * room
    new = np.append(True, (group[1:] != group[:-1]) | (reach[:-1] - first[1:] < period[1:]))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(first)) - 1
    return _shortest(first[at], reach[last], period[at])


def runs_of(ids: np.ndarray, firsts: np.ndarray, seed: int = 0) -> tuple[np.ndarray, ...]:
    """(first word, end, period) of all runs of the texts whose word numbers are ``ids``; texts
    share no number and start at ``firsts``, whose last is the end."""
    nodes, starts = re_pair(ids, firsts)
    if not nodes.parts:  # no pair of words occurs twice
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    _halve(nodes, starts, firsts, 2 * len(ids) + 2)
    symbol, start, left, whole = (c[o] for o in [np.argsort(nodes.arrays()[0], kind="stable")] for c in nodes.arrays())
    long = whole >= LEAST
    symbol, start, left, whole = symbol[long], start[long], left[long], whole[long]
    first_of = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])) if len(symbol) else np.zeros(0, np.int64)
    prefixes = Prefixes(ids, seed)
    node, begin, end, period = _shortest(*crossing(ids, prefixes, start[first_of], left[first_of], whole[first_of]))
    # To every place of the symbol.
    places = np.diff(np.append(first_of, len(symbol)))
    found = []
    for piece in _pieces(places[node]):
        which, k = _numbered(places[node[piece]])
        which = which + piece.start
        moved = start[first_of[node[which]] + k] - start[first_of[node[which]]]
        found.append(_shortest(begin[which] + moved, end[which] + moved, period[which]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    begin, end, period = merged(*(np.concatenate(c) for c in zip(*found)))
    for piece in _pieces(end - begin):
        which, k = _numbered((end - begin - period)[piece])
        at = begin[piece][which] + k
        if not np.array_equal(ids[at], ids[at + period[piece][which]]):
            return runs_of(ids, firsts, seed + 1)
    return begin, end, period


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, where each row's words start and the last end), some _BLOCK_WORDS at a time."""
    parts, row, held = [], 0, 0
    for first, hashes, firsts in hashed_words(column, lower=False):
        if parts and held + len(hashes) > _BLOCK_WORDS:
            yield row, *_joined(parts)
            parts, row, held = [], first, 0
        parts.append((hashes, firsts))
        held += len(hashes)
    if parts:
        yield row, *_joined(parts)


def _joined(parts):
    sizes = np.concatenate([np.diff(firsts) for _, firsts in parts])
    return np.concatenate([h for h, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def _collapsed(words: list[bytes], kept: np.ndarray) -> bytes:
    return b" ".join(words) if kept.all() else b" ".join(words[i] for i in np.flatnonzero(kept))


def _of_batch(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    data, offsets = utf8(texts)
    n_words, n_runs, runs, collapsed = [], [], [[], [], []], []
    for row, hashes, firsts in _blocks(texts):
        begin, end, period = runs_of(_ids(hashes, firsts), firsts)
        change = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(change, begin + period, 1)
        np.add.at(change, end, -1)
        kept = np.cumsum(change)[:-1] == 0
        text = np.searchsorted(firsts, begin, "right") - 1
        n_runs.append(np.bincount(text, minlength=len(firsts) - 1))
        n_words.append(np.diff(firsts))
        for column, values in zip(runs, (begin - firsts[text], end - begin, period)):
            column.append(values)
        for k in range(len(firsts) - 1):
            words = data[offsets[row + k] : offsets[row + k + 1]].tobytes().split()
            collapsed.append(_collapsed(words, kept[firsts[k] : firsts[k + 1]]))
    none = np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(np.concatenate([*n_runs, none]))]).astype(np.int32)
    fields = pa.StructArray.from_arrays(
        [pa.array(np.concatenate([*c, none]).astype(np.int64)) for c in runs], ["start", "length", "period"])
    return (
        pa.array(np.concatenate([*n_words, none]).astype(np.int64)),
        pa.ListArray.from_arrays(pa.array(ends), fields),
        pa.array(collapsed, pa.binary()).cast(pa.string()),
    )


def periodic_runs(documents: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``documents`` but for ``text``, and ``n_words, runs, collapsed``: ``runs`` is the list of (start,
    length, period) by start and period, in words from 0; ``collapsed`` has the words, joined by one
    space, without those that a run repeats (all of it but its first period).

    A word is a run of other than ASCII white space, compared byte by byte. Null and empty texts have no words and no
    runs, and collapse to the empty text. Rows are independent, repeated ones alike; an empty table gives
    no rows. The three names get underscores if the table has them.
    """
    others = [f for f in documents.schema if f.name != text]
    added = [fresh(documents, n) for n in ("n_words", "runs", "collapsed")]
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType(list(others))
    for name, kind in zip(added, (T.LongType(), T.ArrayType(run), T.StringType())):
        schema = schema.add(name, kind)
    names = [f.name for f in schema]

    def found(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, *_of_batch(batch.column(batch.num_columns - 1))], names)

    small_batches(documents.sparkSession)
    return documents.select(*[F.col(f"`{f.name}`") for f in others], F.col(f"`{text}`")).mapInArrow(found, schema)


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the texts, by the CRC-32 of their id, repeat a stretch of their words to the
    end. With g the CRC over ten and n words, words from a = g mod n on are repeated every
    1 + (n - a) div (3 + g mod 8). Texts of a null doc_id stay."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(crc / 10).cast("bigint"), F.size("words").cast("bigint")
    rows = documents.select("doc_id", "text", F.when(crc % 10 == 0, _words()).alias("words"))
    rows = rows.withColumn("a", F.when(n > 0, F.pmod(g, n))).withColumn(
        "p", 1 + F.floor((F.size("words") - F.col("a")) / (3 + g % 8)))

    def word(w: Column, i: Column) -> Column:
        first = (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")
        return F.when(i < F.col("a"), w).otherwise(F.get("words", first))

    planted = F.when(F.col("a").isNotNull(), F.array_join(F.transform("words", word), " "))
    return rows.select("doc_id", F.coalesce(planted, "text").alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the longest run (of equal ones the first, of these the one of least period), and digests."""
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length = -F.col("best.less")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
        length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

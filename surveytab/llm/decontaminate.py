"""Finding benchmark items in documents, with up to a share of edits, by the pigeonhole.

Text is compared as UTF-8 after lower-casing, with ASCII punctuation and white space as single
spaces. An item of m bytes may differ by k = m * percent / 100 edits. It is cut into k + 1
pieces; in any passage within k edits one piece stands unchanged. Pieces are found through a
rolling hash of all windows of a text, worked out with numpy, and compared byte by byte; what lies
around a hit is then measured with Myers' bit-parallel algorithm (1999). A window that has too
few of the item's 3-grams for k edits is passed over first; that never loses a match, since
an edit removes three of them at most.

An item without an edit to spare (12 bytes or less) is found only where it stands as whole words. One
of fewer than LEAST bytes is no sign of a leak inside a longer text: it is found only in a
document that is nothing but the item.

Items go to the tasks in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .text import mixed

PERCENT = 8  # edits allowed per 100 bytes of an item
LEAST = 4  # bytes of an item that is looked for inside a document
BLOCK_BYTES = 4 << 20  # of items that a task holds at once
CHUNK = 1 << 18  # bytes of a text looked at once
WIDTHS = (1, 2, 3, 4, 6, 8, 11)  # window widths; a piece is probed by its first bytes
_U = np.uint64
_R = 0x9E3779B97F4A7C15
_PLAIN = bytes(32 if not (chr(c).isalnum() or c > 127) else c for c in range(256))


_AROUND = (b"", b" ", b"  ")  # of whole words: nothing, or a space on one side or both


def plain(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split())


def myers(pattern: bytes, text: bytes) -> int:
    """Least edit distance between ``pattern`` and any part of ``text``."""
    m, ones, top = len(pattern), (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    pv, mv, score, best = ones, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & ones)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & ones
        mh = (mh << 1) & ones
        pv = mh | (~(xv | ph) & ones)
        mv = ph & xv
        if score < best:
            best = score
    return best


class Items:
    """Benchmark items, ready to be looked for."""

    def __init__(self, rows: list[tuple[int, str]], percent: int):
        self.items = []  # (item_id, text, edits, 3-grams)
        self.alone: dict[bytes, list[int]] = defaultdict(list)  # items that must be the whole text
        pieces: dict[int, dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            item = plain(text)
            if not item:
                continue
            if len(item) < LEAST:
                self.alone[item].append(item_id)
                continue
            k = len(item) * percent // 100
            at = len(self.items)
            self.items.append((item_id, item, k, Counter(item[i : i + 3] for i in range(len(item) - 2))))
            cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
            width = max(w for w in WIDTHS if w <= min(b - a for a, b in zip(cuts, cuts[1:])))
            for a, b in zip(cuts, cuts[1:]):
                pieces[width][item[a : a + width]].append((at, a, item[a:b]))
        self.pieces = {w: dict(p) for w, p in pieces.items()}
        inverse = pow(_R, -1, 1 << 64)
        self.inverse, power = inverse, {}
        self.keys = {}
        for w, p in self.pieces.items():
            probes = sorted(p)
            values = np.array([self._hash(x) for x in probes], _U)
            order = np.argsort(values)
            bits = np.zeros(1 << 22, bool)
            bits[(values >> _U(42)).astype(np.int64)] = True
            self.keys[w] = (values[order], [probes[i] for i in order], bits)

    @staticmethod
    def _hash(probe: bytes) -> int:
        total, place = 0, 1
        for c in probe:
            total = (total + (c + 1) * place) & ((1 << 64) - 1)
            place = place * _R & ((1 << 64) - 1)
        return int(mixed(np.array([total], _U))[0])

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_up") or len(self._up) < n:
            up, down = (np.full(n, x, _U) for x in (_R, self.inverse))
            up[0] = down[0] = 1
            self._up, self._down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self._up, self._down

    def hits(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(item number, place in the text where the item would begin) for every piece found."""
        up, down = self._powers(CHUNK + max(WIDTHS))
        for start in range(0, max(len(text), 1), CHUNK):
            data = np.frombuffer(text[start : start + CHUNK + max(WIDTHS) - 1], np.uint8)
            if not len(data):
                continue
            sums = np.zeros(len(data) + 1, _U)
            np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=sums[1:])
            for width, (values, probes, bits) in self.keys.items():
                if len(data) < width:
                    continue
                n = min(len(data) - width + 1, CHUNK)
                window = mixed((sums[width : width + n] - sums[:n]) * down[:n])
                at = np.flatnonzero(bits[(window >> _U(42)).view(np.int64)])
                where = np.searchsorted(values, window[at])
                where[where == len(values)] = 0
                same = values[where] == window[at]
                for i, j in zip(at[same].tolist(), where[same].tolist()):
                    i += start
                    for item, offset, piece in self.pieces[width][probes[j]]:
                        if text.startswith(piece, i):
                            yield item, i - offset

    def find(self, text: str | None) -> dict[int, int]:
        """{item_id: distance} of the items that the text holds within their budget."""
        body, tried = plain(text), set()
        best = dict.fromkeys(self.alone.get(body, ()), 0)
        for item, begin in self.hits(body):
            item_id, pattern, k, grams = self.items[item]
            slot = (item, begin // (k + 1))
            if slot in tried or best.get(item_id) == 0:
                continue
            tried.add(slot)
            if not k and body[max(begin - 1, 0) : begin] + body[begin + len(pattern) :][:1] not in _AROUND:
                continue
            first = slot[1] * (k + 1) - k
            window = body[max(0, first) : max(0, first + len(pattern) + 4 * k + 1)]
            need = len(pattern) - 2 - 3 * k
            if need > 0 and k:
                held = Counter(window[i : i + 3] for i in range(len(window) - 2))
                if sum(min(n, held[g]) for g, n in grams.items() if g in held) < need:
                    continue
            distance = myers(pattern, window) if k else 0
            if distance <= k:
                best[item_id] = min(distance, best.get(item_id, distance))
        return best


def item_blocks(benchmark: DataFrame, percent: int = PERCENT) -> Iterator[Items]:
    """The benchmark in blocks of at most BLOCK_BYTES; null texts and ids are left out."""
    rows, size = [], 0
    items = benchmark.filter("text is not null and item_id is not null").select("item_id", "text")
    for row in items.orderBy("item_id", "text").toLocalIterator():
        rows.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size > BLOCK_BYTES:
            yield Items(rows, percent)
            rows, size = [], 0
    if rows:
        yield Items(rows, percent)


def leaks(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, distance, contaminated`` (always true): one row per document row and
    item that it holds with at most ``percent`` edits per 100 bytes; the distance is the least one
    found. Null and empty texts hold nothing; an empty benchmark gives no rows; a null
    doc_id is reported as null; a repeated row is reported again."""
    spark, out = documents.sparkSession, None
    small_batches(spark)
    documents = documents.select("doc_id", "text")
    schema = "doc_id bigint, item_id bigint, distance bigint, contaminated boolean"
    for items in item_blocks(benchmark, percent):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in batches:
                found = [
                    (doc, item, distance, True)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for item, distance in sorted(shared.value.find(text).items())
                ]
                columns = zip(*found) if found else [[]] * 4
                types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    ["doc_id", "item_id", "distance", "contaminated"],
                )

        block = documents.mapInArrow(run, schema)
        out = block if out is None else out.unionByName(block)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no benchmark item."""
    spark, at = documents.sparkSession, documents.columns.index("text")
    small_batches(spark)
    for items in item_blocks(benchmark, percent):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in batches:
                clean = [not shared.value.find(t) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents

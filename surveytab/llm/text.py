"""Words of whole Arrow columns as 64-bit hashes, worked out with numpy.

A word is a run of bytes other than the six ASCII white-space characters, so UTF-8 needs
no decoding. A text is cut only at white space while it is worked on, and put together
again: memory is bounded by the longest word, not by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18  # bytes worked on at once
_PLACES = 1 << 18
_U = np.uint64


@lru_cache(maxsize=2)
def _tables(letters: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Is a byte part of a word; its value; its value with A-Z as a-z; value of a place; what makes it 1."""
    is_word = np.ones(256, bool)
    is_word[[0x20, *range(0x09, 0x0E)]] = False
    if letters:
        is_word[:128] = [chr(c).isalnum() for c in range(128)]
    rng = np.random.Generator(np.random.PCG64(20240229))
    value = rng.integers(1, 1 << 63, 256, dtype=_U) | _U(1)
    value[~is_word] = 0
    lower = value.copy()
    lower[65:91] = value[97:123]
    place = np.full(_PLACES, 0x9E3779B97F4A7C15, _U)
    back = np.full(_PLACES, pow(0x9E3779B97F4A7C15, -1, 1 << 64), _U)
    place[0] = back[0] = 1
    return is_word, value, lower, np.multiply.accumulate(place), np.multiply.accumulate(back)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _hash_words(data: np.ndarray, starts_of_rows: np.ndarray, lower: bool, letters: bool):
    """Hashes of the words of ``data`` and the number of words before each row start."""
    is_word, value, lowered, place, back = _tables(letters)
    word = is_word.take(data) if letters else (data != 0x20) & (data - np.uint8(0x09) > 4)
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    before[starts_of_rows[starts_of_rows < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    firsts = np.searchsorted(starts, starts_of_rows)
    if not len(starts):
        return np.zeros(0, _U), firsts
    rest = data[starts[0] :]
    at = starts - starts[0]
    values = (lowered if lower else value).take(rest)
    if len(rest) > len(place):
        offset = np.arange(len(rest)) - np.repeat(at, np.diff(at, append=len(rest)))
        values *= place[offset % len(place)] + (offset // len(place)).astype(_U)
        return mixed(np.add.reduceat(values, at)), firsts
    # Places are counted from the first word, and each word's sum, a difference of running sums, is brought back to its own
    # first place; white space adds nothing. All numbers are modulo 2^64, so nothing is lost.
    values *= place[: len(rest)]
    sums = np.cumsum(values, out=values)
    ends = sums[np.append(at[1:], len(rest)) - 1]
    ends[1:] -= ends[:-1].copy()
    return mixed(ends * back.take(at)), firsts


def _cuts(data: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of pieces of about BLOCK bytes, each after white space."""
    is_word = _tables(False)[0]
    cuts = []
    while end - start > BLOCK:
        at = start + BLOCK
        while at < end and is_word[data[at - 1]]:
            more = np.flatnonzero(~is_word[data[at : min(at + BLOCK, end)]])
            at = at + int(more[0]) + 1 if len(more) else min(at + BLOCK, end)
        cuts.append(at)
        start = at
    return [*cuts, end]


def hashed_words(
    column: pa.Array, lower: bool = True, letters: bool = False
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, where each row's words start and the last end) for a few rows
    at a time, in order. With ``letters``, ASCII punctuation parts words as white space does."""
    data, offsets = utf8(column)
    row, rows = 0, len(column)
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1
        last = min(max(last, row + 1), rows)
        begin, end = int(offsets[row]), int(offsets[last])
        if end - begin <= BLOCK:
            hashes, firsts = _hash_words(data[begin:end], offsets[row:last] - begin, lower, letters)
        else:  # one long text
            parts, start = [], begin
            for cut in _cuts(data, begin, end):
                parts.append(_hash_words(data[start:cut], np.zeros(1, np.int64), lower, letters)[0])
                start = cut
            hashes, firsts = np.concatenate(parts), np.zeros(1, np.int64)
        yield row, hashes, np.append(firsts, len(hashes))
        row = last

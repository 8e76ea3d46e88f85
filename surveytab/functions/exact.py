"""Sums of doubles that do not depend on the order of the rows.

A double is put on a common grid of 2^-52 and split into three whole numbers: the part above one, and
twice 26 bits of the rest. Whole numbers add up alike in any order, so two runs, any partitioning
and a merge of partial sums give the same total, bit for bit. Doubles from 2^-10 on with their last bit on
the grid (from one on, all) are not changed; smaller ones are rounded once, each by itself. The total is
the exact sum on the grid, rounded once to a double, while it stays below 2^53; totals up to 2^63
are possible, and 2^37 rows; more stop the job as an overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

_BITS = 26
_UNIT = 1 << _BITS
_PARTS = ("whole", "high", "low")


def parts(value: Column) -> Column:
    """A double, null or not, as a struct of three whole numbers to be added up."""
    whole = F.floor(value)
    rest = (value - whole) * float(_UNIT)
    high = F.floor(rest)
    low = F.rint((rest - high) * float(_UNIT)).cast("bigint")
    numbers = F.struct(*[c.alias(n) for n, c in zip(_PARTS, (whole, high, low))])
    return F.when(value.isNotNull(), numbers)


def whole_parts(number: Column) -> Column:
    """A whole number as such a struct."""
    zero = F.lit(0).cast("bigint")
    return F.struct(*[c.alias(n) for n, c in zip(_PARTS, (number.cast("bigint"), zero, zero))])


def added(numbers: Column | str, over: WindowSpec | None = None) -> Column:
    """The sum, an aggregate, of structs made by :func:`parts`; null without any."""
    numbers = F.col(numbers) if isinstance(numbers, str) else numbers
    sums = [F.sum(numbers[n]) if over is None else F.sum(numbers[n]).over(over) for n in _PARTS]
    return F.when(sums[0].isNotNull(), F.struct(*[s.alias(n) for n, s in zip(_PARTS, sums)]))


def total(numbers: Column | str) -> Column:
    """The double that a struct of parts stands for."""
    numbers = F.col(numbers) if isinstance(numbers, str) else numbers
    whole, high, low = (numbers[n] for n in _PARTS)
    high = high + F.shiftright(low, _BITS)
    whole = whole + F.shiftright(high, _BITS)
    rest = high.bitwiseAND(F.lit(_UNIT - 1)) * _UNIT + low.bitwiseAND(F.lit(_UNIT - 1))
    return whole.cast("double") + rest.cast("double") * float(2.0 ** (-2 * _BITS))

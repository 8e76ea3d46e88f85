"""Survey codes: how a value is grouped, how it is written, how it is compared.

Codes reach us as integers, doubles, booleans, decimals or text, and the same
code may be an integer in the answers and text in the dictionary. Two forms are
used:

* the *native* form, cheap to hash, for grouping rows (``native_code``);
* the *text* form, for everything a person or a join sees (``text_code``): ``1``,
  ``1.0`` and ``True`` are all written ``"1"``.

Counting works on native codes and turns them into text only after grouping, so
the conversion runs on a handful of rows rather than on every answer.
"""

from __future__ import annotations

import numbers
import operator
from collections.abc import Iterable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BIGINT, DOUBLE, TEXT = "bigint", "double", "string"

# Whole doubles below this size are written as the whole number they hold; from there on,
# and for fractions, as Spark writes a double.
_LARGEST_WHOLE_DOUBLE = 2.0**63


def column(name: str) -> Column:
    """The column called exactly ``name``, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def code_type(data_type: T.DataType) -> str:
    """The native form used for a column of this type."""
    if isinstance(data_type, (T.BooleanType, T.IntegralType)):
        return BIGINT
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return DOUBLE
    return TEXT


def native_code(df: DataFrame, name: str) -> Column:
    """Codes of a column in native form; not-a-number counts as no answer."""
    data_type = df.schema[name].dataType
    col = column(name)
    kind = code_type(data_type)
    if kind == DOUBLE:
        return F.when(~F.isnan(col), col.cast(DOUBLE))
    if kind == BIGINT:
        return col.cast(BIGINT)
    if isinstance(data_type, T.DecimalType) and data_type.scale > 0:
        return F.regexp_replace(col.cast(TEXT), r"\.?0+$", "")
    return col.cast(TEXT)


def text_code(native: Column, kind: str) -> Column:
    """Native codes of the given kind as canonical text."""
    if kind == DOUBLE:
        whole = (native == F.rint(native)) & (F.abs(native) < _LARGEST_WHOLE_DOUBLE)
        return F.when(whole, native.cast(BIGINT).cast(TEXT)).otherwise(native.cast(TEXT))
    return native.cast(TEXT)


def canonical_code(df: DataFrame, name: str) -> Column:
    """Codes of a column as canonical text."""
    return text_code(native_code(df, name), code_type(df.schema[name].dataType))


def shared_code_type(df: DataFrame, names: Iterable[str]) -> str:
    """The native form that can hold every one of the columns."""
    kinds = {code_type(df.schema[name].dataType) for name in names}
    return kinds.pop() if len(kinds) == 1 else TEXT


def code_as(df: DataFrame, name: str, kind: str) -> Column:
    """Codes of a column in the form chosen by :func:`shared_code_type`."""
    return native_code(df, name) if kind != TEXT else canonical_code(df, name)


def literal_code(value: object) -> str:
    """A Python value written as canonical text."""
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        if value.is_integer() and abs(value) < _LARGEST_WHOLE_DOUBLE:
            return str(int(value))
        return _double_text(value)
    if isinstance(value, Decimal):
        return _decimal_text(value)
    if isinstance(value, numbers.Integral):
        return str(int(value))
    if isinstance(value, numbers.Real):
        return literal_code(float(value))
    return str(value)


def _decimal_text(value: Decimal) -> str:
    """A decimal as a DECIMAL column is written: plain digits, no zeros at the end of a fraction."""
    if not value.is_finite():
        return _double_text(float(value))
    text = format(value, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def code_value(code: str, kind: str):
    """The number or text of the given kind that is written as ``code``; None if none is."""
    try:
        number = {BIGINT: int, DOUBLE: float}.get(kind, str)(code)
    except ValueError:
        return None
    if kind == BIGINT and not -(1 << 63) <= number < 1 << 63:
        return None
    # "01" is text that no number is written as.
    return number if literal_code(number) == code else None


def _double_text(value: float) -> str:
    """A double as Spark writes it: with an exponent from 10^7 on and below 10^-3."""
    if value != value or abs(value) == float("inf"):
        return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(value)]
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    text, power = "".join(map(str, digits)), len(digits) + exponent - 1
    if -3 <= power < 7:
        plain = format(Decimal(repr(value)), "f")
        return plain if "." in plain else plain + ".0"
    return f"{'-' * sign}{text[0]}.{text[1:] or '0'}E{power}"


def in_codes(code: Column, codes: Iterable[object]) -> Column:
    """Membership that is never null: a missing code is in no list."""
    listed = [literal_code(c) for c in codes]
    return F.coalesce(code.isin(listed), F.lit(False)) if listed else F.lit(False)


def not_in_codes(code: Column, codes: Iterable[object]) -> Column:
    """The complement of :func:`in_codes`; a missing code is kept."""
    return ~in_codes(code, codes)


def null_codes(df: DataFrame, name: str, codes: Iterable[object]) -> Column:
    """The column with the listed codes turned into nulls, its type unchanged."""
    return F.when(not_in_codes(canonical_code(df, name), codes), column(name))


def numeric_answer(df: DataFrame, name: str, na_codes: Iterable[object]) -> Column:
    """A measured answer as a double, with the listed codes and NaN nulled."""
    col = column(name)
    kind = code_type(df.schema[name].dataType)
    if kind == TEXT and not isinstance(df.schema[name].dataType, T.DecimalType):
        col = null_codes(df, name, na_codes).cast(DOUBLE)
        return F.when(~F.isnan(col), col)
    # Numbers are compared as numbers: no text is made on the hot path.
    col = col.cast(DOUBLE)
    listed = [float(c) for c in na_codes]
    keep = ~F.isnan(col)
    return F.when(keep & ~col.isin(listed) if listed else keep, col)


def any_answered(df: DataFrame, names: Iterable[str]) -> Column:
    """True where at least one of the columns holds an answer; never null."""
    return reduce(operator.or_, [native_code(df, name).isNotNull() for name in names])

"""The counting step that frequencies and reports share.

Every question of a survey is counted in one pass: each row is exploded into
(slot, code) pairs, and one grouping counts them. Grouping is on integers where
the codes are numbers, with partial aggregation before the shuffle, so what is
shuffled is at most one row per task, slot and code, however skewed the codes.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveytab.functions.codes import (
    BIGINT,
    DOUBLE,
    TEXT,
    any_answered,
    code_type,
    native_code,
    text_code,
)
from surveytab.functions.exact import added, parts
from surveytab.functions.frames import pick

def explode_slots(array: str) -> Column:
    """One row per array element, numbered from 0.

    The outer form is meant: the arrays are never empty, and for the inner form
    Spark adds a filter on their size that builds every array a second time.
    """
    return F.posexplode_outer(array)


def explode_lines(df: DataFrame, kept: dict[str, Column], lines: Sequence[dict[str, Column]]):
    """One row per interview and line, all lines having the same fields. A single
    line needs no exploding."""
    kept_columns = [c.alias(name) for name, c in kept.items()]
    if len(lines) == 1:
        return df.select(*kept_columns, *[c.alias(name) for name, c in lines[0].items()])
    structs = [F.struct(*[c.alias(name) for name, c in line.items()]) for line in lines]
    return (
        df.select(*kept_columns, F.array(*structs).alias("lines"))
        .select(*kept, explode_slots("lines").alias("slot", "line"))
        .select(*kept, "line.*")
    )


@dataclass(frozen=True)
class Slot:
    """One thing to count in every row.

    ``counts_codes`` slots feed the table of a variable, ``counts_base`` slots
    its base; a single-choice question does both with one slot. With ``option``
    set, an answer is reported under that name instead of its code.
    """

    variable: str
    code: Column
    kind: str
    counts_codes: bool = True
    counts_base: bool = False
    option: str | None = None


def single_slots(df: DataFrame, variables: Sequence[str]) -> list[Slot]:
    return [
        Slot(v, native_code(df, v), code_type(df.schema[v].dataType), counts_base=True)
        for v in variables
    ]


def multiple_slots(df: DataFrame, groups: dict[str, Sequence[str]]) -> list[Slot]:
    out = []
    for group, columns in groups.items():
        out += [Slot(group, native_code(df, c), code_type(df.schema[c].dataType)) for c in columns]
        out.append(_answered_slot(df, group, columns))
    return out


def mentioned_slots(df: DataFrame, groups: dict[str, Sequence[str]]) -> list[Slot]:
    one = {BIGINT: F.lit(1), DOUBLE: F.lit(1.0), TEXT: F.lit("1")}
    out = []
    for group, columns in groups.items():
        for c in columns:
            kind = code_type(df.schema[c].dataType)
            mentioned = F.when(native_code(df, c) == one[kind], F.lit(1)).cast(BIGINT)
            out.append(Slot(group, mentioned, BIGINT, option=c))
        out.append(_answered_slot(df, group, columns))
    return out


def _answered_slot(df: DataFrame, group: str, columns: Sequence[str]) -> Slot:
    answered = F.when(any_answered(df, columns), F.lit(1)).cast(BIGINT)
    return Slot(group, answered, BIGINT, counts_codes=False, counts_base=True)


def tally(
    df: DataFrame,
    slots: Sequence[Slot],
    weights: dict[str, Column],
    keys: dict[str, Column] | None = None,
) -> DataFrame:
    """Rows, answers and weight per key, variable and code.

    Columns: the keys, ``variable, counts_codes, counts_base`` (0 or 1), ``code,
    row_order, rows, n`` and one weight total per entry of ``weights``, as a struct
    of :mod:`surveytab.functions.exact`, which adds up alike in any order. The null
    code is kept: its ``rows`` are the rows without an answer and its ``n`` is 0.

    Choose cells with :func:`is_code_cell` and :func:`is_base_cell`. They test
    counts, which no filter pushdown can take below the grouping; a filter on the
    code itself would be, and each use of a tally would then scan the data anew
    instead of sharing one scan and one shuffle.

    Numbers sort by their value (``row_order``, a double), text codes by their text. Slots of
    different native forms share the pass: a cell has a field for each form in use, of which
    one is filled.
    """
    keys = keys or {}
    cells = _tally_slots(df, slots, weights, keys)
    labels = [(s.variable, s.counts_codes, s.option) for s in slots]
    if len(set(labels)) < len(labels):
        # Several slots of one group: add up what was counted slot by slot.
        cells = cells.groupBy(
            *keys, "variable", "counts_codes", "counts_base", "code"
        ).agg(
            F.min("row_order").alias("row_order"),
            F.sum("rows").alias("rows"),
            F.sum("n").alias("n"),
            *[added(w).alias(w) for w in weights],
        )
    return cells


def is_code_cell() -> Column:
    """Cells that are lines of a table: answers of a slot that counts codes."""
    return F.col("n") * F.col("counts_codes") > 0


def is_base_cell() -> Column:
    """Cells whose rows belong to the base of their variable."""
    return F.col("n") * F.col("counts_base") > 0


def code_of_cell() -> Column:
    """The code of a code cell, never null. It leans on a count, so that a filter
    or join on it stays above the grouping too."""
    return F.coalesce(F.when(F.col("n") > 0, F.col("code")), F.lit(""))


def _tally_slots(df, slots, weights, keys) -> DataFrame:
    forms = [form for form in (BIGINT, DOUBLE, TEXT) if any(s.kind == form for s in slots)]
    if len(forms) == 1:
        codes = [s.code for s in slots]
        fields = {"native": "native"}
    else:
        fields = {f"native_{form}": f"native.native_{form}" for form in forms}
        codes = [
            F.struct(*[
                (s.code if s.kind == form else F.lit(None).cast(form)).alias(f"native_{form}")
                for form in forms
            ])
            for s in slots
        ]
    exploded = df.select(
        *[c.alias(name) for name, c in keys.items()],
        *[parts(c).alias(name) for name, c in weights.items()],
        F.array(*codes).alias("codes"),
    ).select(*keys, *weights, explode_slots("codes").alias("slot", "native"))
    # The outer explode calls the slot nullable. Saying that it is not keeps Spark
    # from adding a null test to some uses of the tally and not to others.
    numbered = exploded.select(
        *keys, *weights, F.coalesce("slot", F.lit(0)).alias("slot"),
        *[F.col(path).alias(name) for name, path in fields.items()],
    )
    counted = numbered.groupBy(*keys, "slot", *fields).agg(
        F.count(F.lit(1)).alias("rows"), *[added(w).alias(w) for w in weights]
    )
    native = dict(zip(forms, [F.col(name) for name in fields]))
    code = F.coalesce(*[text_code(c, form) for form, c in native.items()])
    answered = reduce(operator.or_, [c.isNotNull() for c in native.values()])
    numbers = [c.cast(DOUBLE) for form, c in native.items() if form != TEXT]
    order = F.coalesce(*numbers, F.lit(0.0))
    if any(s.option for s in slots):
        option = pick([s.option for s in slots], "slot", "string")
        code = F.when(answered, F.coalesce(option, code))
        order = F.when(option.isNull(), order).otherwise(F.lit(0.0))
    return counted.select(
        *keys,
        pick([s.variable for s in slots], "slot").alias("variable"),
        pick([int(s.counts_codes) for s in slots], "slot").alias("counts_codes"),
        pick([int(s.counts_base) for s in slots], "slot").alias("counts_base"),
        code.alias("code"),
        order.alias("row_order"),
        "rows",
        (F.col("rows") * answered.cast("int")).alias("n"),
        *weights,
    )

"""Crosstabs: how the codes of one question spread within those of another.

Percentages add up to 100 within each code of the column variable. Codes outside
the dictionary fall into the null category, which is kept and counts in the
percentages. Pairs that never occur together have no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveytab.functions.codes import code_as, shared_code_type, text_code
from surveytab.functions.exact import added, parts, total
from surveytab.functions.frames import (
    broadcast_if_bounded,
    literal_rows,
    percent,
    pick,
    require_columns,
    weight_column,
)
from surveytab.operators.domain import with_dictionary_code
from surveytab.operators.packs import PackedKeys, choose_packs, listed_codes, questions_of
from surveytab.operators.tally import explode_lines


def cross_single(
    df: DataFrame,
    options: DataFrame,
    pairs: Sequence[tuple[str, str]],
    weight: str | None = None,
    null_weight: str = "raise",
) -> DataFrame:
    """Single choice by single choice; ``pairs`` are (column, row) variables."""
    lines = [(col, row, row) for col, row in pairs]
    return _cross(df, options, lines, weight, null_weight)


def cross_multiple(
    df: DataFrame,
    options: DataFrame,
    pairs: Sequence[tuple[str, str]],
    groups: dict[str, Sequence[str]],
    weight: str | None = None,
    null_weight: str = "raise",
) -> DataFrame:
    """Single choice by multiple response; ``pairs`` are (column variable, group).

    Slots are counted, not persons: an empty slot counts in the null row and in
    the percentages.
    """
    unknown = [g for _, g in pairs if g not in groups]
    if unknown:
        raise ValueError(f"groups without slots: {', '.join(unknown)}")
    lines = [(col, group, slot) for col, group in pairs for slot in groups[group]]
    return _cross(df, options, lines, weight, null_weight)


def cross_many(
    df: DataFrame,
    options: DataFrame | None,
    pairs: Sequence[tuple[str, str]],
    groups: dict[str, Sequence[str]] | None = None,
    weight: str | None = None,
    null_weight: str = "raise",
) -> DataFrame:
    """Any number of crosstabs, of questions of any type, from one scan.

    ``pairs`` are (column variable, row variable or group); the slots of a group are counted as in
    :func:`cross_multiple`. Questions are counted in packs (:mod:`surveytab.operators.packs`): a row makes a
    line per pack and not per pair, and codes become text after counting. Without a
    dictionary (``options`` None) all codes found are kept as they are, and the orders are null.
    """
    groups = groups or {}
    lines = [(col, name, slot) for col, name in dict.fromkeys(pairs) for slot in groups.get(name, [name])]
    if not lines:
        raise ValueError("no pairs given")
    return _table(_count_packs(df, options, lines, weight, null_weight), options)


# With more lines than this, pairs are counted in packs.
_FEW_LINES = 4


def _cross(df, options, lines, weight, null_weight) -> DataFrame:
    """``lines`` are (column variable, name of the row variable, its column)."""
    count = _count_lines if len(lines) <= _FEW_LINES else _count_packs
    return _table(count(df, options, lines, weight, null_weight), options)


def _count_lines(df, options, lines, weight, null_weight) -> DataFrame:
    """Counted pairs of codes, a line per pair."""
    require_columns(df, [c for col, _, row in lines for c in (col, row)])
    names = list(dict.fromkeys((col, name) for col, name, _ in lines))
    col_kind = shared_code_type(df, [col for col, _, _ in lines])
    row_kind = shared_code_type(df, [row for _, _, row in lines])
    pairs = [
        {
            "pair": F.lit(names.index((col, name))),
            "col": code_as(df, col, col_kind),
            "row": code_as(df, row, row_kind),
        }
        for col, name, row in lines
    ]
    counted = (
        explode_lines(df, {"w": parts(weight_column(df, weight, null_weight))}, pairs)
        .groupBy("pair", "col", "row")
        .agg(F.count(F.lit(1)).alias("n"), added("w").alias("n_weighted"))
    )
    return counted.select(
        pick([name for _, name in names], "pair").alias("row_variable"),
        pick([col for col, _ in names], "pair").alias("col_variable"),
        text_code(F.col("row"), row_kind).alias("row_code"),
        text_code(F.col("col"), col_kind).alias("col_code"),
        "n",
        "n_weighted",
    )


def _count_packs(df, options, lines, weight, null_weight) -> DataFrame:
    """Counted pairs of codes, a line per pack of questions."""
    require_columns(df, [c for col, _, row in lines for c in (col, row)])
    names = list(dict.fromkeys((col, name) for col, name, _ in lines))
    wanted = [q for col, name, row in lines for q in ((col, col), (row, name))]
    questions = questions_of(df, wanted, listed_codes(options, [v for _, v in wanted]))
    number = {(q.column, q.variable): i for i, q in enumerate(questions)}
    # The same two questions may belong to several pairs of names only if they are the same pair.
    pair_of = {(number[col, col], number[row, name]): names.index((col, name)) for col, name, row in lines}
    keys = PackedKeys(df, questions, choose_packs(list(pair_of), questions))
    counted = (
        keys.exploded({"w": parts(weight_column(df, weight, null_weight))})
        .groupBy(*keys.names)
        .agg(F.count(F.lit(1)).alias("n"), added("w").alias("n_weighted"))
    )
    of_names = literal_rows(
        df.sparkSession, {"of_first": "int", "of_second": "int", "pair": "int"},
        [[*pair, i] for pair, i in pair_of.items()])
    same = (F.col("first") == F.col("of_first")) & (F.col("second") == F.col("of_second"))
    return (
        keys.spread(counted)
        .groupBy("first", "second", "first_code", "second_code")
        .agg(F.sum("n").alias("n"), added("n_weighted").alias("n_weighted"))
        .join(broadcast_if_bounded(of_names, len(pair_of)), same)
        .select(
            pick([name for _, name in names], "pair").alias("row_variable"),
            pick([col for col, _ in names], "pair").alias("col_variable"),
            F.col("second_code").alias("row_code"),
            F.col("first_code").alias("col_code"),
            "n",
            "n_weighted",
        )
    )


def _table(coded: DataFrame, options: DataFrame | None) -> DataFrame:
    """The crosstabs from counted pairs of codes."""
    if options is None:
        no_order = F.lit(None).cast("bigint")
        coded = coded.withColumns({"row_order": no_order, "col_order": no_order})
    else:
        coded = with_dictionary_code(coded, options, "col_variable", "col_code", "col_order")
        coded = with_dictionary_code(coded, options, "row_variable", "row_code", "row_order")
    # Codes outside the dictionary have just become one category; a column now
    # has at most the dictionary's codes and that one, so the window stays small.
    keys = ["row_variable", "col_variable", "row_code", "col_code", "row_order", "col_order"]
    table = coded.groupBy(*keys).agg(
        F.sum("n").alias("n"), added("n_weighted").alias("n_weighted")
    )
    column = Window.partitionBy("row_variable", "col_variable", "col_code")
    return table.select(
        *keys,
        "n",
        total("n_weighted").alias("n_weighted"),
        percent(F.col("n"), F.sum("n").over(column)).alias("pct"),
        percent(total("n_weighted"), total(added("n_weighted", column))).alias("pct_weighted"),
    )


def in_dictionary_order(table: DataFrame) -> DataFrame:
    """Columns, then rows, as the dictionary lists them; the null category last."""
    first = [c for c in ("row_variable", "mean_variable") if c in table.columns]
    orders = [c for c in ("col_order", "row_order") if c in table.columns]
    return table.orderBy(
        *first, "col_variable", *[F.col(o).asc_nulls_last() for o in orders]
    )

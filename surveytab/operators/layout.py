"""Other shapes for frequency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveytab.functions.codes import column, literal_code
from surveytab.functions.frames import sql_literal
from surveytab.functions.names import clean_names, repair_names

_MEASURES = ("n", "n_weighted", "pct", "pct_weighted")

# Codes or splits that may become columns of one table when the caller does not list them.
MOST_COLUMNS = 2_000
# Splits side by side in one table of layout_compare_blocks.
BLOCK_SPLITS = 250
# Stands for the split of rows without one.
_NO_SPLIT = "NA"


def layout_tidy(table: DataFrame) -> DataFrame:
    """One row per code, with the totals and base percentages as columns."""
    def on(kind, name):
        return F.max(F.when(F.col("row_kind") == kind, F.col(name)))

    keys = [c for c in ("split", "variable") if c in table.columns]
    summary = (
        table.filter(F.col("row_kind") != "code")
        .groupBy(*[F.col(k).alias(f"of_{k}") for k in keys])
        .agg(
            on("total", "n").alias("total"),
            on("total", "n_weighted").alias("total_weighted"),
            on("base", "pct").alias("pct_base"),
            on("base", "pct_weighted").alias("pct_base_weighted"),
        )
    )
    codes = table.filter(F.col("row_kind") == "code")
    same = [F.col("variable") == F.col("of_variable")]
    same += [F.col("split").eqNullSafe(F.col("of_split"))] if "split" in keys else []
    return codes.join(summary, same, "left").select(
        *keys, "code", *_MEASURES, "total", "total_weighted", "pct_base", "pct_base_weighted"
    )


def _found(values: DataFrame, what: str) -> list[str]:
    """The different values of a table's one column, in order; they become columns."""
    rows = values.distinct().orderBy(*values.columns).limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(
            f"more than {MOST_COLUMNS} {what}: list the ones to show, or use layout_map, "
            "which has no columns for them, or blocks of columns (layout_compare_blocks)"
        )
    return list(dict.fromkeys(r[-1] for r in rows))


def _only_listed(value: Column, listed: Sequence[str], unlisted: str, what: str) -> Column:
    """The value, if it is listed; what is not stops the job, or is null (``unlisted='drop'``)."""
    if unlisted not in ("raise", "drop"):
        raise ValueError("unlisted must be 'raise' or 'drop'")
    kept = F.when(value.isin(list(listed)), value)
    if unlisted == "drop":
        return kept
    message = F.concat(F.lit(f"{what} not listed: "), value)
    return F.coalesce(kept, F.raise_error(message).cast("string"))


def layout_wide(
    table: DataFrame, codes: Sequence | None = None, unlisted: str = "raise"
) -> DataFrame:
    """Two rows per variable, weighted percentages and weighted counts, with one
    column per code, ``Total`` and ``Base``; what is missing is 0.

    Without ``codes``, all codes found are columns, in table order. A code that is not listed
    stops the job, unless ``unlisted='drop'``. A code that is called like another column
    gets ``...position`` behind its name, as the other does.
    """
    if codes is None:
        coded = table.filter(F.col("row_kind") == "code")
        listed = _found(coded.select("row_order", "code"), "codes")
    else:
        listed = list(dict.fromkeys(literal_code(c) for c in codes))
    long = table.unpivot(
        [c for c in ("split", "variable", "code", "row_kind") if c in table.columns],
        ["pct_weighted", "n_weighted"],
        "measure",
        "value",
    )
    # The kind of a row is part of its name: a code may be called "Total".
    name = F.when(
        F.col("row_kind") == "code",
        F.concat(F.lit("code "), _only_listed(F.col("code"), listed, unlisted, "code")),
    ).otherwise(F.col("row_kind"))
    keys = [c for c in ("split", "variable", "measure") if c in long.columns]
    cells = [*[f"code {c}" for c in listed], "total", "base"]
    wide = (
        long.withColumn("cell", name).groupBy(*keys).pivot("cell", cells)
        .agg(F.first("value", ignorenulls=True))
    )
    order = F.when(F.col("measure") == "pct_weighted", 1).otherwise(2)
    names = repair_names([*keys, "row_order", *listed, "Total", "Base"])[len(keys) + 1 :]
    return wide.na.fill(0.0, cells).select(
        *keys, order.alias("row_order"), *[column(c).alias(n) for c, n in zip(cells, names)]
    )


def layout_compare(
    table: DataFrame, splits: Sequence | None = None, unlisted: str = "raise"
) -> DataFrame:
    """Splits side by side: one column per measure and split, clean names, and 0
    where a split does not have the code. ``table`` is a table made with ``by``, labelled or not.

    Without ``splits``, all that are found are shown; rows without a split are the split
    ``NA``. A split that is not listed stops the job, unless ``unlisted='drop'``.
    """
    split = F.coalesce("split", F.lit(_NO_SPLIT))
    if splits is None:
        listed = _found(table.select(split.alias("split")), "splits")
    else:
        listed = [_NO_SPLIT if s is None else literal_code(s) for s in splits]
    keys = ["variable", "code", "row_kind", "row_order"]
    keys += [c for c in ("label",) if c in table.columns]
    listed = list(dict.fromkeys(listed))
    # Splits may differ in case only, which names of columns must not: the pivot is on positions.
    split = _only_listed(split, listed, unlisted, "split")
    places = F.expr(f"array({', '.join(map(sql_literal, listed))})") if listed else F.array().cast("array<string>")
    wide = (
        table.withColumn("_place", F.array_position(places, split).cast("int"))
        .groupBy(*keys)
        .pivot("_place", list(range(1, len(listed) + 1)))
        .agg(*[F.first(m, ignorenulls=True).alias(m) for m in _MEASURES])
    )
    pairs = [(measure, place) for measure in _MEASURES for place in range(len(listed))]
    names = clean_names([f"{measure}_{listed[place]}" for measure, place in pairs])
    return wide.select(
        *keys,
        *[
            F.coalesce(column(f"{place + 1}_{measure}"), F.lit(0)).alias(name)
            for (measure, place), name in zip(pairs, names)
        ],
    )


def layout_map(table: DataFrame) -> DataFrame:
    """Splits side by side without a column for each, whatever their number: one row per code as in
    :func:`layout_compare`, and for every measure a map from split to value, in the order of the splits. A
    split that does not have the code is not in the maps; rows without a split are the split ``NA``.

    Nothing goes through the driver; a row holds as many entries as there are splits.
    """
    keys = ["variable", "code", "row_kind", "row_order"]
    keys += [c for c in ("label",) if c in table.columns]
    values = [F.coalesce(m, F.lit(0)).alias(m) for m in _MEASURES]
    entry = F.struct(F.coalesce("split", F.lit(_NO_SPLIT)).alias("split"), *values)
    rows = table.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    splits = F.col("_entries.split")
    return rows.select(*keys, *[F.map_from_arrays(splits, F.col(f"_entries.{m}")).alias(m) for m in _MEASURES])


def layout_compare_blocks(
    table: DataFrame, splits: Sequence | None = None, width: int = BLOCK_SPLITS
) -> list[DataFrame]:
    """:func:`layout_compare` of any number of splits, in tables of ``width`` splits each on the same keys: every
    table has a row for every code, so they can be put side by side. Without ``splits``, all that are found
    are shown; their names go through the driver."""
    if width < 1:
        raise ValueError("width must be positive")
    split = F.coalesce("split", F.lit(_NO_SPLIT))
    if splits is None:
        splits = [r[0] for r in table.select(split.alias("s")).distinct().orderBy("s").collect()]
    return [
        layout_compare(table, splits[at : at + width], unlisted="drop") for at in range(0, len(splits), width)
    ]

"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveytab.functions.codes import column


def sql_literal(value, data_type: str | None = None) -> str:
    """A Python value as SQL text. Long lists of literals reach Spark as one
    expression this way, instead of one call to the JVM per value."""
    if value is None:
        text = "NULL"
    elif isinstance(value, bool):
        text = str(value)
    elif isinstance(value, int):
        text = f"{value}L" if abs(value) >= 1 << 31 else str(value)
    elif isinstance(value, float):
        text = f"double('{value}')"
    else:
        escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
        # Spark puts session settings in the place of ${...} before it reads the text.
        escaped = escaped.replace("$", "\\u0024")
        text = f"'{escaped}'"
    return f"cast({text} AS {data_type})" if data_type else text


def literal_rows(spark: SparkSession, schema: dict[str, str], rows: Sequence[Sequence]) -> DataFrame:
    """A frame of literals, for lists the caller wrote by hand (specs, names)."""
    names = ", ".join(schema)
    lines = [
        "(" + ", ".join(sql_literal(v, t) for t, v in zip(schema.values(), row)) + ")"
        for row in rows or [[None] * len(schema)]
    ]
    frame = spark.sql(f"SELECT * FROM VALUES {', '.join(lines)} AS t({names})")
    return frame if rows else frame.limit(0)


def pick(values: Iterable, index: str, data_type: str | None = None) -> Column:
    """The literal at the zero-based position that a column holds."""
    literals = ", ".join(sql_literal(v, data_type) for v in values)
    return F.expr(f"element_at(array({literals}), cast({index} AS int) + 1)")


# Rows that may be sent to every executor: a few tens of MB at the very most.
_MOST_BROADCAST_ROWS = 100_000


def broadcast_if_bounded(df: DataFrame, most_rows: int) -> DataFrame:
    """Ask for a broadcast of a frame that has at most ``most_rows`` narrow rows by
    construction, if that is few; else leave the join to Spark."""
    return F.broadcast(df) if most_rows <= _MOST_BROADCAST_ROWS else df


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {', '.join(missing)}")


def weight_column(df: DataFrame, weight: str | None, null_weight: str) -> Column:
    """The weight as a double; without one, every row weighs 1.

    A null weight (or one that is not a number) stops the job, unless ``null_weight='ignore'`` lets such rows
    count as rows that weigh nothing.
    """
    if null_weight not in ("raise", "ignore"):
        raise ValueError("null_weight must be 'raise' or 'ignore'")
    if weight is None:
        return F.lit(1.0)
    require_columns(df, [weight])
    value = column(weight).cast("double")
    value = F.when(~F.isnan(value), value)
    if null_weight == "ignore":
        return F.coalesce(value, F.lit(0.0))
    message = f"null weight in column {weight}; pass null_weight='ignore' to skip such rows"
    return F.coalesce(value, F.raise_error(F.lit(message)).cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null where there is nothing to divide by."""
    return F.try_divide(F.lit(100.0) * part, whole.cast("double"))

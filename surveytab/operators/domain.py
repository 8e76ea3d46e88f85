"""The dictionary as the set of codes a question may have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_dictionary_code(
    grouped: DataFrame, options: DataFrame, variable: str, code: str, order: str
) -> DataFrame:
    """Replace codes the dictionary does not list by null; add their position.

    ``grouped`` holds one row per code, not per interview, so this join is small
    whatever the number of interviews; it needs no hint, since Spark sees the size
    of both sides at run time.
    """
    twice = F.raise_error(F.concat(F.lit("listed twice in the dictionary: "), F.col("_code")))
    listed = (
        options.groupBy(F.col("variable").alias("_variable"), F.col("code").alias("_code"))
        .agg(F.min("option_id").alias("_first"), F.count(F.lit(1)).alias("_times"))
        .select(
            "_variable",
            "_code",
            F.when(F.col("_times") == 1, F.col("_first"))
            .otherwise(twice.cast("int"))
            .alias(order),
        )
    )
    same = (F.col(variable) == F.col("_variable")) & (F.col(code) == F.col("_code"))
    return (
        grouped.join(listed, same, "left")
        .withColumn(code, F.col("_code"))
        .drop("_variable", "_code")
    )

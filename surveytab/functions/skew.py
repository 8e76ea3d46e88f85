"""Joins in which a few keys hold a large part of one side's rows.

Heavy keys are found by a frequent-items sketch, merged from all tasks, in a scan of the key alone.
Their rows on the heavy side are dealt out over so many parts of the key, and the other side's rows
are repeated once per part. All other keys have one part. The sketch decides only how rows are
dealt out, never the result. Nothing passes through the driver but the list of heavy keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Items the sketch keeps; heavy keys at most (rows broadcast); parts of a key per even share of the rows.
_TRACKED, _MOST_KEYS, _FINE = 10_000, 1_000, 8
_COUNTABLE = (T.IntegralType, T.FractionalType, T.StringType, T.DateType, T.TimestampType)


def heavy_keys(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """``key, parts``: keys with more rows than an even share of the rows for each of ``tasks``, and
    how many parts to make of them. Keys that hold less than about one row in three thousand are not told apart."""
    found = df.select(df[key].alias("key")).filter("key is not null").agg(
        F.count("*").alias("rows"), F.expr(f"approx_top_k(key, {_MOST_KEYS}, {_TRACKED})").alias("top"))
    share = F.col("top.count") * tasks / F.col("rows")
    return found.select("rows", F.explode("top").alias("top")).filter(share > 1).select(
        F.col("top.item").alias("key"), F.ceil(share * _FINE).cast("int").alias("parts"))


def spread_join(left: DataFrame, right: DataFrame, left_on: int, right_on: int) -> DataFrame:
    """Inner join on equality of one column of each side, given by position; all columns of both sides, with
    their names. ``right`` is the side with the heavy keys.

    Rows are dealt out by their place in their partition, so ``right`` should be read from files; write it
    first if its order may change when a lost task runs again.
    """
    names = [*left.columns, *right.columns]
    mine = [f"l{i}" for i in range(len(left.columns))]
    theirs = [f"r{i}" for i in range(len(right.columns))]
    left, right = left.toDF(*mine), right.toDF(*theirs)
    left_key, right_key = mine[left_on], theirs[right_on]
    if not isinstance(right.schema[right_key].dataType, _COUNTABLE):
        return left.join(right, F.col(left_key) == F.col(right_key)).select(*mine, *theirs).toDF(*names)
    tasks = int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(right, right_key, tasks)
    found = heavy.collect()  # _MOST_KEYS rows at most
    if not found:
        return left.join(right, F.col(left_key) == F.col(right_key)).select(*mine, *theirs).toDF(*names)
    heavy = F.broadcast(right.sparkSession.createDataFrame(found, heavy.schema))
    parts = F.coalesce("parts", F.lit(1))
    repeated = left.join(heavy, F.col(left_key) == F.col("key"), "left").select(
        *mine, F.explode(F.sequence(F.lit(0), parts - 1)).alias("left_part"))
    dealt = right.join(heavy, F.col(right_key) == F.col("key"), "left").select(
        *theirs, F.pmod(F.monotonically_increasing_id(), parts).cast("int").alias("right_part"))
    on = (F.col(left_key) == F.col(right_key)) & (F.col("left_part") == F.col("right_part"))
    return repeated.join(dealt, on).select(*mine, *theirs).toDF(*names)

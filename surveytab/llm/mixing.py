"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes are words. A source's target is its weight's share of the mix, stopped at a multiple of
   the source's size; what that leaves over goes to the others by weight, until none is above.
2. Documents fall into 4096 blocks per source by a hash. A source's blocks stand in a permuted
   order, once for each epoch; it gives blocks in this order until its target is reached,
   and documents of the last block in permuted order up to the document that comes nearest.
   The number of blocks is the source's exact quota.
3. A binary tree splits the quotas among the output shards. At a node with n blocks, the left child
   gets half of them; how many of each source follows the multivariate hypergeometric
   distribution, drawn here by what defines it: n/2 of the node's units, chosen without return by
   keyed hashes. The leaves' counts are the shards' quotas.
4. The shards cut each source's permuted order into disjoint runs of their quotas, take
   these blocks, and put their documents in a keyed order of their own.

Windows are over a source's blocks (epochs x 4096), over a 4096th of a node's blocks, and, of documents,
over the one block per source that is taken in part. All draws are hashes of a
seed, so reruns agree. Everything is column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import fresh, written

WEIGHTS = (5, 2, 1)  # of the sources by code point, repeating
SHARE = 1.5  # of all words
EPOCHS = 2  # a target stops at so many times its source's size
SHARDS = 16
BLOCK_DIGITS = 3  # hexadecimal: 4096 blocks per source
RANGE_DIGITS = 3  # hexadecimal, of a split's keyed hash: units of a node are ranked in 4096 ranges
MOST_BROADCAST = 200_000  # rows of the plan (blocks) sent to all executors at most


def _digest(seed: str, what: str, *columns: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.lit(what), *columns))


def word_count(text: str = "text") -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    gaps = F.size(F.split(F.concat(trimmed, F.lit(" ")), r"[\x20\x09-\x0D]+")) - 1
    return F.when(F.length(trimmed) > 0, gaps).otherwise(0).cast("bigint")


def source_targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    # Sources reach their stop in the order of size / weight: the water level rises past them.
    whole = Window.partitionBy()
    below = Window.orderBy("stop_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    asked = (
        sources.withColumn("weight", weight)
        .withColumn("stop", F.col("source_size") * float(most))
        .withColumn("stop_at", F.col("stop") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(whole) * float(share))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("level", (F.col("all_words") - F.coalesce(F.sum("stop").over(below), F.lit(0.0)))
                    / (F.col("all_weight") - F.coalesce(F.sum("weight").over(below), F.lit(0.0))))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("stop_at"), F.col("level"))).over(whole))
    )
    target = F.when(F.col("level").isNull() | (F.col("stop_at") <= F.col("level")), F.col("stop")).otherwise(
        F.col("weight") * F.col("level"))
    return asked.select("source", "source_size", target.alias("target"))


def shard_quotas(units: DataFrame, shards: int, seed: str) -> DataFrame:
    """``source, shard, quota`` from one row ``source, unit`` per block to deal out: the
    leaves of the splitting tree. ``shards`` is a power of two.

    A unit's place among its node's is the number of units in lower ranges of the keyed hash, from counts
    by range, and its place within its own range, so no task holds all units of a node."""
    nodes = units.select("source", "unit", F.lit(0).alias("node"))
    for level in range(shards.bit_length() - 1):
        key = _digest(seed, f"split {level}", "node", F.coalesce("source", F.lit("\0")), "unit")
        nodes = nodes.withColumn("key", key).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
        nodes = written(nodes, f"split-{level}")  # used twice
        below = Window.partitionBy("node").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
        ranges = nodes.groupBy("node", "range").agg(F.count("*").alias("n")).select(
            "node", "range", (F.sum("n").over(below) - F.col("n")).alias("before"),
            F.floor((F.sum("n").over(Window.partitionBy("node")) + 1) / 2).alias("half"))
        inside = Window.partitionBy("node", "range").orderBy("key", "unit")
        left = F.col("before") + F.row_number().over(inside) <= F.col("half")
        nodes = nodes.join(ranges, ["node", "range"]).select(
            "source", "unit", (F.col("node") * 2 + F.when(left, 0).otherwise(1)).alias("node"))
    return nodes.groupBy("source", F.col("node").alias("shard")).agg(F.count("*").alias("quota"))


def _sized(documents: DataFrame, size: Column, seed: str) -> DataFrame:
    """With ``size`` (words), ``place`` (the document's place in any order) and ``block``."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return (
        documents.withColumn("size", size).withColumn("place", _digest(seed, "document", name))
        .withColumn("block", F.substring("place", 1, BLOCK_DIGITS))
    )


def mixing_plan(
    sized: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS, shards=SHARDS, seed="mix"
) -> DataFrame:
    """One row per block of ``sized`` (source, block, size): ``source, block, source_size, target``
    and ``whole``, the list of (epoch, shard) that take all of it, and ``part``, the
    (epoch, shard, begins) that takes some, ``begins`` being how many words the source has given
    before; null if none does."""
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    targets = source_targets(
        blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs
    ).withColumnRenamed("source", "of")
    blocks = written(
        blocks.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of"), "blocks")
    order = Window.partitionBy("source").orderBy(
        "epoch", _digest(seed, "block", "epoch", "block"), "block")
    taken = (
        blocks.filter("words > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
        .withColumn("unit", F.concat_ws("/", "epoch", "block"))
        .withColumn("begins", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        .withColumn("rank", F.row_number().over(order) - 1)
        .filter("begins < target")
    )
    taken = written(taken, "taken")
    runs = shard_quotas(taken, shards, seed).withColumn(
        "to", F.sum("quota").over(Window.partitionBy("source").orderBy("shard")))
    runs = runs.groupBy(F.col("source").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("to", "shard"))).alias("runs"))  # a row per shard
    dealt = taken.join(runs, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "shard", F.expr("filter(runs, x -> x.to > rank)[0].shard"))
    all_of_it = F.col("begins") + F.col("words") <= F.col("target")
    dealt = dealt.groupBy(F.col("source").alias("of"), F.col("block").alias("b")).agg(
        F.array_sort(F.collect_list(F.when(all_of_it, F.struct("epoch", "shard")))).alias("whole"),
        F.max(F.when(~all_of_it, F.struct("epoch", "shard", "begins"))).alias("part"),
    )
    return blocks.join(
        dealt, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b")), "left"
    ).select("source", "block", "source_size", "target", "whole", "part")


def _drawn(sized: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``sized`` with the plan's columns, and ``draws``, the list of (epoch, shard) that take the row. Of
    a block taken in part, a document is taken if the target lies at or beyond its middle."""
    plan = plan.select(F.col("source").alias("of"), F.col("block").alias("in_block"), "source_size", "target", "whole", "part")
    if plan.count() <= MOST_BROADCAST:
        plan = F.broadcast(plan)
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in_block")))
    whole = F.coalesce("whole", F.array().cast("array<struct<epoch:int,shard:int>>"))
    inside = Window.partitionBy("source", "block").orderBy(
        _digest(seed, "inside", "part.epoch", "place"), "size")
    middle = F.col("part.begins") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    some = joined.filter("part is not null").withColumn("in", (middle <= F.col("target")) & (F.col("size") > 0))
    some = some.withColumn("draws", F.when(F.col("in"), F.concat(whole, F.array(F.struct("part.epoch", "part.shard")))).otherwise(whole)).drop("in")
    rest = joined.filter("part is null").withColumn("draws", whole)
    return rest.unionByName(some).drop("of", "in_block", "whole", "part")


def mixed_sizes(documents: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, shards`` for every row of ``documents``
    (doc_id, text, source).

    ``size`` is the number of words, 0 for a null or empty text; ``target`` is the source's;
    ``taken`` is how many of the document's words the mix holds, repeats counted (0, 1 or 2
    times its size), and ``shards`` names the leaves of the tree that take them, by epoch, joined by
    commas (empty for none). A null source is a source of its own, the last. Rows with a null doc_id take part.
    Rows of the same doc_id share a place in the order, the shorter first. An empty
    table gives no rows.
    """
    seed = options.get("seed", "mix")
    sized = written(_sized(documents.select("doc_id", "source", "text"), word_count(), seed).drop("text"), "sized")
    plan = written(mixing_plan(sized, **options), "plan")
    takers = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")
    return _drawn(sized, plan, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"),
        F.when(F.col("size") > 0, takers).otherwise("").alias("shards"))


def mixture(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``documents`` as often as they are taken, with ``epoch``,
    ``shard`` and ``shard_order``, the place of the row among its shard's (a hash to sort by). Documents
    without words are not in it. The three names get underscores if the table has them."""
    seed = options.get("seed", "mix")
    kept = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    rows = _sized(documents.select("doc_id", "source", "text", kept.alias("row")), word_count(), seed).drop("text")
    plan = written(mixing_plan(written(rows.select("source", "block", "size"), "sized"), **options), "plan")
    drawn = _drawn(rows, plan, seed).select("row", "place", F.explode("draws").alias("draw"))
    order = _digest(seed, "order", "draw.shard", "draw.epoch", "place")
    more = {"epoch": F.col("draw.epoch"), "shard": F.col("draw.shard"), "shard_order": order}
    return drawn.select("row.*", *[c.alias(fresh(documents, n)) for n, c in more.items()])


def write_mixture(mix: DataFrame, path: str) -> None:
    """A folder per shard; its files, in the order of their names, hold the shard's rows in order."""
    mix.repartitionByRange("shard", "shard_order").sortWithinPartitions("shard", "shard_order").write.partitionBy(
        "shard").parquet(path)

"""Sharding by a two-pass external shuffle: scatter, then Fisher-Yates within buckets.

1. Every record gets a place, a seeded hash of all its columns. Records fall into buckets by a
   hash of the place, as many buckets as the table's bytes over ``bucket_bytes``, a task each, so a
   bucket fits in a task's memory. Records that have very many identical copies
   are collapsed to one with a number before they are scattered, and each copy falls by a hash of
   its own: copies do not gather in one bucket, and their texts do not travel to one task.
2. Each bucket has a permutation of its slots, drawn by Spark's ``shuffle``, which is Fisher and
   Yates's. A bucket's records, in the order of their places, take the slots of the permutation.
3. Buckets stand one behind the other; a shard is a run of these positions. Shards therefore
   differ by one record at most (the law ``rows``), and every order is as likely as any other.

The counts of the buckets come from a narrow table (a place and a size per record), so texts are
read twice and moved once. Buckets, places and permutations depend on the seed and the records
alone: reruns agree, and so does a task that is run again. Everything is column functions.

Null and empty texts are records like others; repeated rows keep their number; an empty table
gives no rows; a table's own columns ``shard`` and ``slot`` stay, and the new ones get underscores.
Columns of type map or variant cannot be hashed and take no part in the place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import fresh, shared_folder, written

SHARDS = 16
BUCKET_BYTES = 32 << 20  # of records, as they lie in memory
ROW_BYTES = 64  # what a record takes besides its text
MOST_BUCKETS = 100_000  # a task each; beyond 3 TB buckets grow, to 1 GB at 100 TB
MOST_HEAVY = 100_000  # records that may have copies enough to be collapsed: a bound, not a cap
BUCKETS_AT_ONCE = 1_024  # buckets whose counts are added up in one window

LAW = "rows"


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint")


def _hash(seed: int, what: str, *columns: Column) -> Column:
    return F.xxhash64(F.lit(f"{what} {seed}"), *columns)


def _placed(records: DataFrame, seed: int, *more: Column) -> DataFrame:
    """``row``, the whole record, two hashes of it, 128 bits together, and ``more`` columns."""
    hashed = [
        F.col(f"`{f.name}`") for f in records.schema
        if not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    row = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    return records.select(
        row.alias("row"), _hash(seed, "place", *hashed).alias("place"), _hash(seed, "check", *hashed).alias("check"), *more)


def starts(counts: DataFrame, number: str, n: str) -> DataFrame:
    """``counts`` with ``start``, the sum of ``n`` over all smaller numbers, in two steps: within
    groups of numbers, and over the groups."""
    group = F.floor(F.col(number) / BUCKETS_AT_ONCE).cast("bigint")
    before = Window.orderBy("of_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        counts.groupBy(group.alias("of_group")).agg(F.sum(n).alias("in_group"))
        .select("of_group", F.coalesce(F.sum("in_group").over(before), F.lit(0)).alias("group_start"))
    )
    within = Window.partitionBy("group").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("group", group)
        .withColumn("start", F.coalesce(F.sum(n).over(within), F.lit(0)))
        .join(groups, F.col("group") == F.col("of_group"))
        .withColumn("start", F.col("start") + F.col("group_start"))
        .drop("group", "of_group", "group_start")
    )


def external_shuffle(
    records: DataFrame, size: Column, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = 11
) -> DataFrame:
    """``records`` with ``shard`` (int, from 0) and ``slot`` (long, from 0 within the shard).
    ``size`` is the number of bytes of a record, never null. ``records`` must give the same rows each time."""
    if shards < 1 or bucket_bytes < 1:
        raise ValueError("shards and bucket_bytes must be positive")
    placed = _placed(records, seed)
    light = written(_placed(records, seed, size.alias("size")).select("place", "check", "size"), "places")
    rows, total = light.agg(F.count("*"), F.sum(F.col("size") + ROW_BYTES)).first()
    shard, slot = fresh(records, "shard"), fresh(records, "slot")
    if not rows:
        return records.withColumns({shard: F.lit(0), slot: F.lit(0).cast("bigint")})
    buckets = min(MOST_BUCKETS, -(-total // bucket_bytes))
    # Fewer than MOST_HEAVY records can have more copies than this.
    copies_of_heavy = max(ROW_BYTES, -(-rows // min(MOST_HEAVY, 8 * buckets)))
    return _shuffled(records, placed, light, rows, buckets, copies_of_heavy, shards, seed, shard, slot)


def _shuffled(records, placed, light, rows, buckets, copies_of_heavy, shards, seed, shard, slot):
    counted = written(light.groupBy("place", "check").agg(F.count("*").alias("copies")), "copies")
    heavy = counted.filter(F.col("copies") > copies_of_heavy)
    bucket = F.pmod(_hash(seed, "bucket", F.col("place"), F.col("copy")), F.lit(buckets)).cast("int")
    some = counted.filter(F.col("copies") <= copies_of_heavy).select(
        "place", F.lit(0).cast("bigint").alias("copy"), "copies")
    many = heavy.select("place", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"),
                        F.lit(1).cast("bigint").alias("copies"))
    counts = some.unionByName(many).groupBy(bucket.alias("bucket")).agg(F.sum("copies").alias("n"))
    # The draws of `shuffle` go by the seed and the number of the task, which is the bucket's.
    slots = starts(counts, "bucket", "n").repartitionById(buckets, F.col("bucket")).select(
        F.col("bucket").alias("of_bucket"), "start",
        F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(seed)).alias("slots"))
    slots = written(slots, "slots")

    rest = placed.withColumn("copy", F.lit(0).cast("bigint"))
    if heavy.limit(1).count():
        of_heavy = F.broadcast(heavy.select("place", "check"))  # fewer than MOST_HEAVY rows of 16 bytes
        collapsed = (
            placed.join(of_heavy, ["place", "check"]).groupBy("place", "check")
            .agg(F.first("row").alias("row"), F.count("*").alias("copies"))
        )
        copies = collapsed.select("row", "place", "check", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
        rest = rest.join(of_heavy, ["place", "check"], "left_anti").select("row", "place", "check", "copy").unionByName(copies)
    in_bucket = Window.partitionBy("bucket").orderBy("place", "check", "copy")
    position = F.col("start") + F.get("slots", F.col("index"))
    return (
        rest.select("row", "place", "check", "copy", bucket.alias("bucket")).repartitionById(buckets, F.col("bucket"))
        .withColumn("index", F.row_number().over(in_bucket) - 1)
        .join(slots.repartitionById(buckets, F.col("of_bucket")), F.col("bucket") == F.col("of_bucket"))
        .select("row", position.alias("position"))
        .withColumn("of_shard", F.expr(f"position * {shards} div {rows}"))
        .select(
            "row.*", F.col("of_shard").cast("int").alias(shard),
            (F.col("position") - F.expr(f"(of_shard * {rows} + {shards - 1}) div {shards}")).alias(slot),
        )
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """A folder per shard under ``path``; every file holds its rows by ascending slot. ``shuffled`` is
    what :func:`external_shuffle` gives: its last two columns are shard and slot."""
    shard, slot = shuffled.columns[-2:]
    shuffled.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def sharded(documents: DataFrame, **options) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``documents``
    (doc_id, text): read back from the shards, which are written to the shared folder.

    ``size`` is the text's bytes and one; ``text_crc32`` is that of the text (of nothing for null).
    """
    spark = documents.sparkSession
    shuffled = external_shuffle(documents, text_bytes() + 1, **options)
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(shuffled, path)
    shard, slot = shuffled.columns[-2:]
    shards = spark.read.schema(shuffled.schema).parquet(path)
    return shards.select(
        "doc_id", (text_bytes() + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

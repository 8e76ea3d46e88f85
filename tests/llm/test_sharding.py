import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from surveytab.llm import sharding as S

from .helpers import documents, prose


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(i, 3 + i % 40), "aa", f"s{i % 3}", 0) for i in range(600)]
    out += [(None, "the same", None, None, 0)] * 300  # a third of all rows
    return out + [(900, None, None, None, 0), (901, "", "", "", 0), (902, "é " * 100_000, "aa", "s1", 0)]


def brute_law(found, n, shards):
    """Counts at most one apart, slots without gaps."""
    counts = Counter(r.shard for r in found)
    assert sorted(counts) == list(range(min(shards, n))) or n >= shards
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(counts[s]))


def test_every_row_whole_once_and_evenly(spark, rows):
    got = S.sharded(documents(spark, rows).repartition(3), bucket_bytes=2_000).collect()
    expected = Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    brute_law(got, len(rows), 16)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_whole_records_reruns_and_order_of_input(spark, rows):
    table = documents(spark, rows)
    first = S.external_shuffle(table, S.text_bytes() + 1, bucket_bytes=2_000)
    again = S.external_shuffle(table.repartition(5).orderBy(F.desc("doc_id")), S.text_bytes() + 1, bucket_bytes=2_000)
    a, b = (Counter(map(tuple, df.collect())) for df in (first, again))
    assert a == b
    assert Counter(r[:5] for r in a.elements()) == Counter(rows)
    other = S.external_shuffle(table, S.text_bytes() + 1, bucket_bytes=2_000, seed=12)
    assert Counter(map(tuple, other.collect())) != a


def test_permutations_are_as_likely_as_each_other(spark):
    """The place of a row is even over the slots, and so is that of its neighbour in the input."""
    table = spark.range(3).selectExpr("id as doc_id", "string(id) as text")
    seen = Counter()
    for seed in range(14):
        got = S.external_shuffle(table, S.text_bytes(), shards=1, seed=seed).collect()
        seen[tuple(r.doc_id for r in sorted(got, key=lambda r: r.slot))] += 1
    assert len(seen) >= 4 and max(seen.values()) <= 8


def test_copies_do_not_gather_in_one_bucket(spark, rows):
    table = documents(spark, rows).select("doc_id", "text")
    got = S.external_shuffle(table, S.text_bytes() + 1, bucket_bytes=4_000).collect()
    copies = Counter(r.shard for r in got if r.text == "the same")
    assert len(copies) == 16 and max(copies.values()) < 45


def test_starts_are_prefix_sums(spark):
    counts = spark.range(5_000).selectExpr("id * 3 as b", "id % 7 as n").filter("n > 0")
    sums, before = S.starts(counts, "b", "n").orderBy("b").collect(), 0
    for r in sums:
        assert r.start == before
        before += r.n


def test_edges(spark, tmp_path):
    assert S.sharded(documents(spark, [])).collect() == []
    assert S.sharded(documents(spark, [(1, "a", None, None, 0)])).first().slot == 0
    clash = documents(spark, [(i, "a", "b", "c", 0) for i in range(40)]).selectExpr("*", "'x' as shard", "'y' as Slot", "1 as place")
    got = S.external_shuffle(clash, S.text_bytes(), shards=4)
    assert got.columns == [*clash.columns, "shard_", "slot_"]
    S.write_shards(got, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r.shard_ for r in back.collect()) == {0: 10, 1: 10, 2: 10, 3: 10}
    with pytest.raises(ValueError):
        S.external_shuffle(clash, S.text_bytes(), shards=0)

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from surveytab.llm import mixing as M

from .helpers import WORD, documents, prose


def water(sizes, share=1.5, most=2):
    """Targets by resharing until nobody is above the stop; sizes by source in order."""
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    total, targets, free = share * sum(sizes.values()), {}, dict(weights)
    while free:
        left = total - sum(targets.values())
        asked = {s: left * w / sum(free.values()) for s, w in free.items()}
        above = {s for s in free if asked[s] > most * sizes[s]}
        if not above:
            return targets | asked
        for s in above:
            targets[s] = most * sizes[s]
            del free[s]
    return targets


def digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def brute(rows):
    """(doc_id, size, source_size, target, taken) of every row."""
    size = [len(WORD.findall(t or "")) for _, t, _, _, _ in rows]
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    sizes = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    targets, taken = water(sizes), Counter()
    for s in sources:
        draws = []
        for k, r in enumerate(rows):
            if r[3] == s and size[k]:
                place = digest("mix", "document", "null" if r[0] is None else r[0])
                draws += [(e, digest("mix", "block", e, place[:3]), place[:3], digest("mix", "inside", e, place), size[k], k) for e in (1, 2)]
        before = 0
        for *_, n, k in sorted(draws):
            if before + n / 2 <= targets[s]:
                taken[k] += n
            before += n
    return [(r[0], size[k], sizes[r[3]], round(targets[r[3]], 6), taken[k]) for k, r in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(i, 3 + i * 7 % 40), None, f"s{i % 3 if i % 2 else 0}", 0) for i in range(300)]
    out += [(400 + i, prose(i, 5), None, None, 0) for i in range(20)]
    return out + [(500, None, None, "s1", 0), (501, " ", None, "s9", 0), (None, "a b c", None, "s2", 0)]


def test_sizes_targets_and_draws_equal_brute_force(spark, rows):
    found = M.mixed_sizes(documents(spark, rows).repartition(3)).collect()
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in found]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    source = {r[0]: r[3] for r in rows}
    for s in ("s0", "s1", "s2", None):
        mine = [r for r in found if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine)
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in mine)
    assert sorted(map(str, M.mixed_sizes(documents(spark, rows)).collect())) == sorted(map(str, found))


def test_mixture_holds_what_the_sizes_say(spark, rows):
    table = documents(spark, rows).withColumnRenamed("lang", "shard")
    mix = M.mixture(table, shards=4)
    assert mix.columns == [*table.columns, "epoch", "shard_", "shard_order"]
    drawn = mix.collect()
    taken = {r.doc_id: r.taken for r in M.mixed_sizes(documents(spark, rows)).collect()}
    words = Counter()
    for r in drawn:
        words[r.doc_id] += len(r.text.split())
    assert {d: n for d, n in taken.items() if n} == dict(words)
    assert {r["shard_"] for r in drawn} == set(range(4))
    assert max(Counter((r.doc_id, r.epoch) for r in drawn).values()) == 1  # disjoint
    blocks = defaultdict(set)
    for r in drawn:
        blocks[r["shard_"]].add((r.source, r.epoch, digest("mix", "document", r.doc_id)[:3]))
    n = sorted(map(len, blocks.values()))
    assert n[-1] - n[0] <= 2 and sum(n) == len(set().union(*blocks.values()))


def test_tree_splits_exact_quotas_as_chance_would(spark):
    units = spark.range(60).select(F.when(F.col("id") < 40, "a").otherwise("b").alias("source"), F.col("id").cast("string").alias("unit"))
    total = Counter()
    for seed in "xyz":
        quotas = M.shard_quotas(units, 4, seed).collect()
        by_shard = Counter()
        for r in quotas:
            by_shard[r.shard] += r.quota
            total[r.source] += r.quota
        assert sorted(by_shard.values()) == [15] * 4
    assert total == {"a": 120, "b": 60}


def tree(units, shards, seed):
    """Units by shard: at each node the lower half by hash goes left."""
    nodes = {0: units}
    for level in range(shards.bit_length() - 1):
        below = {}
        for node, here in nodes.items():
            here = sorted(here, key=lambda u: (digest(seed, f"split {level}", node, *u), u[1]))
            half = (len(here) + 1) // 2
            below |= {2 * node: here[:half], 2 * node + 1: here[half:]}
        nodes = below
    return nodes


def test_tree_equals_brute_force_and_its_counts_are_hypergeometric(spark):
    units = [("a" if i % 3 else "b", f"1/{i:03x}") for i in range(700)]
    table = spark.createDataFrame(units, "source string, unit string").repartition(3)
    expected = Counter((u[0], shard) for shard, here in tree(units, 8, "k").items() for u in here)
    assert {(r.source, r.shard): r.quota for r in M.shard_quotas(table, 8, "k").collect()} == expected
    few = units[:30]  # 10 of b; 15 go left
    left = [sum(u[0] == "b" for u in tree(few, 2, seed)[0]) for seed in range(4000)]
    mean = sum(left) / len(left)
    variance = sum((n - mean) ** 2 for n in left) / len(left)
    assert abs(mean - 5) < 0.1 and abs(variance - 15 * (1 / 3) * (2 / 3) * 15 / 29) < 0.15


def test_the_tree_decides_which_shards_take_a_document(spark, rows):
    table = documents(spark, rows)
    for shards in (1, 4):
        sizes = {r.doc_id: r for r in M.mixed_sizes(table, shards=shards).collect()}
        by_shard = defaultdict(list)
        for r in M.mixture(table, shards=shards).collect():
            by_shard[r.doc_id].append((r.epoch, r.shard))
        assert {d: [s for _, s in sorted(x)] for d, x in by_shard.items()} == {
            d: [int(s) for s in r.shards.split(",")] for d, r in sizes.items() if r.shards}
        assert all(r.taken == r["size"] * len(r.shards.split(",")) for r in sizes.values() if r.shards)
        assert all(r.taken == 0 for r in sizes.values() if not r.shards)


def test_edges(spark, tmp_path):
    assert M.mixed_sizes(documents(spark, [])).collect() == [] and M.mixture(documents(spark, [])).collect() == []
    same = documents(spark, [(1, "a b", None, "s", 0)] * 4 + [(1, "a b c d", None, "s", 0)])
    assert sum(r.taken for r in M.mixed_sizes(same).collect()) in range(16, 21)
    long = documents(spark, [(1, "a " * 200_000, None, None, 0), (2, "", None, None, 0)])
    assert sorted((r.doc_id, r["size"], r.target) for r in M.mixed_sizes(long).collect()) == [(1, 200_000, 300_000.0), (2, 0, 300_000.0)]
    M.write_mixture(M.mixture(same, shards=2), str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).count() == M.mixture(same, shards=2).count()

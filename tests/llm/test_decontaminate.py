import random

import pytest

from surveytab.llm import decontaminate as D

from .helpers import documents, prose


def distance(pattern, text):
    """Least edit distance to any part of text, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edit(text, n, rng):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1 :]])
    return text


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        p, t = ("".join(rng.choices("abc", k=rng.randint(1, 40))) for _ in range(2))
        assert D.myers(p.encode(), t.encode()) == distance(p, t)


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(i, prose(i, 16, "aa")) for i in range(12)] + [(50, None), (None, "x y z"), (51, ""), (52, "tiny"), (53, "Étude für, zwei!")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def planted(bench):
    rng, rows = random.Random(4), []
    for doc in range(60):
        item = bench[0][doc % 12][1]
        passage = edit(item, doc // 3, rng) if doc % 5 else item.upper().replace(" ", " \n, ")
        rows.append((doc, prose(900 + doc, 40, "bb") + " " + passage + ". " + prose(700 + doc, 20, "bb")))
    rows += [(100 + k, prose(5000 + k, 60, "aa")) for k in range(30)]
    rows += [(200, None), (201, ""), (202, "a tiny one"), (203, "etude; ÉTUDE, Für zwei"), (None, bench[0][0][1]), (0, rows[0][1])]
    return [(i, t, None, None, 0) for i, t in rows]


def test_finds_equal_brute_force(spark, bench):
    rows = planted(bench)
    expected = set()
    for doc, text, *_ in rows:
        for item, pattern in bench[0]:
            p = D.plain(pattern)
            if item is not None and p:
                d = distance(p, D.plain(text))
                if d <= len(p) * D.PERCENT // 100:
                    expected.add((doc, item, d))
    found = D.leaks(documents(spark, rows).repartition(2), bench[1]).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == expected
    assert all(r.contaminated for r in found) and len([r for r in found if r.doc_id == 0]) == 2 * len([e for e in expected if e[0] == 0])


@pytest.mark.parametrize("block, chunk", [(1, 1 << 20), (4 << 20, 64)])
def test_blocks_and_chunks_do_not_matter(spark, bench, monkeypatch, block, chunk):
    rows = planted(bench)
    whole = {(r.doc_id, r.item_id) for r in D.leaks(documents(spark, rows[:30]), bench[1].limit(4)).collect()}
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    if chunk < 100:
        items = next(D.item_blocks(bench[1]))
        monkeypatch.setattr(D, "CHUNK", chunk)
        assert {(i, j) for i, t, *_ in rows[:30] for j in items.find(t)} >= whole
    else:
        assert {(r.doc_id, r.item_id) for r in D.leaks(documents(spark, rows[:30]), bench[1].limit(4)).collect()} == whole


def test_clean_documents_stay_with_all_columns(spark, bench):
    rows = planted(bench)
    leaking = {r.doc_id for r in D.leaks(documents(spark, rows), bench[1]).collect()}
    table = documents(spark, rows).withColumnRenamed("lang", "item_id")
    kept = D.without_leaks(table, bench[1])
    assert kept.columns == table.columns
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == sorted(r[0] for r in rows if r[0] not in leaking)
    assert kept.filter("doc_id >= 100 and doc_id < 200").count() == 30


def test_short_items_stand_as_whole_words(spark):
    items = spark.createDataFrame([(1, "a"), (2, "Yes."), (3, "tick"), (4, "one two")], "item_id long, text string")
    texts = ["Yesterday bob took cats", "a", "yes!", "YES and a", "ticking clocks tick", "unticked sticks", "one twos", "bone two", "one, two", "so one two", "tick"]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    found = {(r.doc_id, r.item_id, r.distance) for r in D.leaks(documents(spark, rows), items).collect()}
    assert found == {(1, 1, 0), (2, 2, 0), (4, 3, 0), (8, 4, 0), (9, 4, 0), (10, 3, 0)}
    kept = D.without_leaks(documents(spark, rows), items).collect()
    assert sorted(r.doc_id for r in kept) == [0, 3, 5, 6, 7]


def test_empty_tables_and_long_text(spark, bench):
    assert D.leaks(documents(spark, []), bench[1]).collect() == []
    assert D.leaks(documents(spark, planted(bench)[:2]), bench[1].limit(0)).collect() == []
    long = prose(1, 300_000, "bb") + " " + bench[0][3][1] + " " + prose(2, 10, "bb")
    assert [(r.item_id, r.distance) for r in D.leaks(documents(spark, [(1, long, None, None, 0)]), bench[1]).collect()] == [(3, 0)]

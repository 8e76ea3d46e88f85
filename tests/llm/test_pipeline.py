import random

import corpus_pipeline
import pytest

import __spark_entry__ as driver
from surveytab.llm.queries import ORACLE, QUERIES
from workload.check import connect, differences

from .helpers import prose

SF = "/root/testdata/sf0.001"


def edited(text, seed):
    words = text.split()
    words[random.Random(seed).randrange(len(words))] = "changed"
    return " ".join(words)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents in two languages with copies, near copies, leaks, personal data and odd rows."""
    path = tmp_path_factory.mktemp("tables")
    bench = [(i, prose(9000 + i, 30)) for i in range(3)]
    rows = [(i, prose(i, 30 + i % 60, "aa" if i % 2 else "bb"), "aa" if i % 2 else "bb", f"s{i % 4}") for i in range(200)]
    rows += [(300 + i, rows[i][1], rows[i][2], "s0") for i in range(10)]  # copies
    rows += [(320 + i, edited(rows[60 + i][1], i), rows[60 + i][2], "s1") for i in range(60) if len(rows[60 + i][1].split()) > 60]
    rows += [(400 + i, prose(700 + i, 20) + " " + bench[i][1], "aa", "s2") for i in range(3)]
    rows += [(500, prose(800, 40) + " mail joe.doe@mail.example.com", "aa", "s2"), (501, None, "aa", "s2"), (502, "", None, None), (503, "123", None, "s3")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {r[0]: r for r in rows}


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, path).cache()
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixed":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    gone = lambda a, b: set(a) - set(b)
    assert gone(rows, kept["language"]) == {501, 502, 503}
    near = gone(kept["language"], kept["near_duplicates"])
    assert near == {i for i in rows if 300 <= i < 400}
    assert gone(kept["near_duplicates"], kept["decontaminated"]) == {400, 401, 402}
    assert set(kept["private"]) == set(kept["decontaminated"])
    changed = {i for i, r in kept["private"].items() if r.text != rows[i][1]}
    assert changed == {500} and "joe.doe" not in kept["private"][500].text and "@mail.example.com" in kept["private"][500].text
    assert set(kept["mixed"]) <= set(kept["private"]) and all(kept["mixed"][i].text == kept["private"][i].text for i in kept["mixed"])


def test_run_is_the_stages_one_after_the_other(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    a, b = (sorted(map(str, d.collect())) for d in (docs, corpus_pipeline.run(spark, path)))
    assert a == b


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert {"pipeline", *QUERIES} <= driver.queries().keys() and ORACLE.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert differences(connect(SF), QUERIES[name](spark, SF), ORACLE[name]) == []


def test_stages_take_empty_tables_and_clashing_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "'x' as shard", "1 as node", "2L as rank")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).collect() == []
        if name != "mixed":
            assert stage(spark, docs, path).columns == docs.columns

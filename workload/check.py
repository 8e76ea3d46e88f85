"""Compare every query with its SQL, in Spark and DuckDB, on one data folder."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(v, ".10g")
    return v


def as_bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


# The same kind of number on both sides; widths must agree too.
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def differences(con, df, sql: str) -> list[str]:
    ours = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    columns = {d[0]: str(d[1]) for d in result.description}
    theirs = result.fetchall()
    out = []
    expected = {name: KINDS.get(kind, kind) for name, kind in df.dtypes}
    if expected != columns:
        differing = set(expected.items()) ^ set(columns.items())
        out.append(f"schema: {sorted(differing)}")
    if set(expected) == set(columns):
        a, b = as_bag(df.columns, ours), as_bag(list(columns), theirs)
        if a != b:
            out.append(f"rows: {len(ours)} and {len(theirs)}; only Spark {list((a - b))[:3]}; "
                       f"only SQL {list((b - a))[:3]}")
    return out


def main(sf_dir: str, only: list[str]) -> int:
    from workload.oracle import ORACLE
    from workload.queries import QUERIES
    from workload.session import local_session

    spark, con = local_session(), connect(sf_dir)
    failed = 0
    for name, query in QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            found = differences(con, query(spark, sf_dir), ORACLE[name])
        except Exception as error:  # report and go on to the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s", *found, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

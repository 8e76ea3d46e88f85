"""What a stored report is made of: one entry per batch of interviews, the latest counts.

A run writes its files in folders of its own and adds its entry last, one file with one row. Until then
nothing of it is seen; from then on all of it is. An entry replaces earlier ones of its batch. One writer at
a time is assumed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveytab.functions.frames import literal_rows

_SCHEMA = {"number": "bigint", "batch": "string", "run": "string", "spec": "string"}


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    schema = ", ".join(f"{n} {t}" for n, t in _SCHEMA.items())
    try:
        return spark.read.schema(schema).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def entries(spark: SparkSession, path: str) -> dict[str, tuple[str, str]]:
    """The run and the specification of every batch; empty without a stored report."""
    found = _read(spark, path)
    if found is None:
        return {}
    latest = found.groupBy("batch").agg(F.max(F.struct("number", "run", "spec")).alias("last"))
    return {r["batch"]: (r["last"]["run"], r["last"]["spec"]) for r in latest.collect() if r["last"]["run"]}


def commit(spark: SparkSession, path: str, batch: str, run: str | None, spec: str) -> None:
    """Make a run the batch's; without a run, take the batch out."""
    found = _read(spark, path)
    last = found.agg(F.max("number")).first()[0] if found is not None else None
    row = literal_rows(spark, _SCHEMA, [[(last or 0) + 1, batch, run, spec]])
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def remove_unused(spark: SparkSession, path: str, kinds=("counts", "moments")) -> list[str]:
    """Delete the folders of runs that no entry names: replaced ones, and those that failed. Not while a
    run is writing. Returns their names."""
    used, gone = {run for run, _ in entries(spark, path).values()}, []
    hadoop = spark._jvm.org.apache.hadoop.fs
    for kind in kinds:
        folder = hadoop.Path(f"{path}/{kind}")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(folder) if files.exists(folder) else []:
            name = status.getPath().getName()
            if name.startswith("run=") and name.removeprefix("run=") not in used:
                files.delete(status.getPath(), True)
                gone.append(f"{kind}/{name}")
    return gone

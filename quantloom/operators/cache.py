"""Results by what they were asked for: a table that was built with the same name and parameters from the same inputs is read, not built."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.session import scratch


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def state_of(spark: SparkSession, inputs: list[str]) -> list[tuple]:
    """(name, length, time of change) of every file under the inputs; no data is read. A manifest.json or _manifest counts as any file."""
    out = []
    for root in sorted(inputs):
        fs, p = _path(spark, root)
        if not fs.exists(p):
            raise FileNotFoundError(root)
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def cached(spark: SparkSession, name: str, parameters: dict, inputs: list[str], build: Callable[[], DataFrame], root: str | None = None) -> tuple[DataFrame, bool]:
    """(table, whether it was there already).

    A table is stored under its name and parameters, and below that under the state of its inputs; when that has
    changed, the tables of other states go. A table counts once its writing has ended, so a broken run leaves none.
    Parameters are what JSON can hold; their order plays no part.
    """
    base = f"{root or scratch(spark) + '/results'}/{name}/{_digest(parameters)}"
    folder = f"{base}/{_digest(state_of(spark, inputs))}"
    fs, done = _path(spark, f"{folder}/_SUCCESS")
    if fs.exists(done):
        return spark.read.parquet(folder), True
    build().write.mode("overwrite").parquet(folder)
    _, parent = _path(spark, base)
    for other in fs.listStatus(parent):
        if other.getPath().toString().rstrip("/").rsplit("/", 1)[-1] != folder.rsplit("/", 1)[-1]:
            fs.delete(other.getPath(), True)
    return spark.read.parquet(folder), False

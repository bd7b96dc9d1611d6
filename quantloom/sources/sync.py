"""A panel kept year by year, whose readers see the state of one whole sync or of the one before.

Data files are never replaced. A sync writes the files of each year into a folder of its own, hashes only these,
and then moves a new manifest, which names every file that counts, over the old one. A year that fails keeps the
files it had, and its error is in the manifest. What a broken sync has left is in no manifest; `vacuum` deletes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources.artifacts import read_json, write_json
from quantloom.sources.panel import FIELDS, SCHEMA

#: Rows of a file at most: no file comes near the 2 GB that one binary value can hold.
MOST_ROWS = 10_000_000


def _digests(spark: SparkSession, folder: str) -> list[dict]:
    """year, name (from load= on), bytes, sha256 of the data files of one load; a file is hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    name, year = F.regexp_extract("path", r"(load=[^/]+/year=\d+/[^/]+)$", 1), F.regexp_extract("path", r"/year=(\d+)/", 1).cast("int")
    listed = files.select(name.alias("name"), year.alias("year"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return [r.asDict() for r in listed.orderBy("name").collect()]


def manifest(spark: SparkSession, root: str) -> dict:
    return read_json(spark, f"{root}/manifest.json", {"files": [], "errors": {}, "load": None})


def sync_years(spark: SparkSession, root: str, years: Iterable[int], of_year: Callable[[int], DataFrame]) -> dict:
    """Take in the given years (of_year gives a year's panel) and return the new manifest.

    Years are written one after the other, each by as many tasks as it has parts. Rows of other years are left out.
    """
    before, load = manifest(spark, root), uuid.uuid4().hex
    done, errors, files = set(), {}, []
    for year in sorted(set(years)):
        folder = f"{root}/data/load={load}/year={year}"
        try:
            rows = of_year(year).select(*FIELDS).where(F.year("trade_date") == year)
            rows.sortWithinPartitions("ts_code", "trade_date").write.mode("overwrite").option("maxRecordsPerFile", MOST_ROWS).parquet(folder)
            found = [f for f in _digests(spark, folder) if f["bytes"]]
            if spark.read.schema(SCHEMA).parquet(folder).isEmpty():
                raise ValueError("no rows")
        except Exception as e:  # noqa: BLE001  a year that fails must not stop the others
            errors[str(year)] = f"{type(e).__name__}: {e}".split("\n")[0][:300]
            continue
        done.add(year)
        files += found
    kept = [f for f in before["files"] if f["year"] not in done]
    still = {y: e for y, e in before["errors"].items() if int(y) not in done}
    after = {"load": load, "files": sorted(kept + files, key=lambda f: f["name"]), "errors": still | errors}
    write_json(spark, f"{root}/manifest.json", after)
    return after


def read_synced(spark: SparkSession, root: str, start: int, end: int, verify: bool = True) -> DataFrame:
    """Whole years from start to end as of the manifest; fails if a year is missing or a file isn't the one that was written."""
    listed = [f for f in manifest(spark, root)["files"] if start <= f["year"] <= end]
    missing = sorted(set(range(start, end + 1)) - {f["year"] for f in listed})
    if missing:
        raise FileNotFoundError(f"years without data: {', '.join(map(str, missing))}")
    if verify:
        want = {f["name"]: f["sha256"] for f in listed}
        for folder in sorted({n.rsplit("/", 1)[0] for n in want}):
            have = {f["name"]: f["sha256"] for f in _digests(spark, f"{root}/data/{folder}")}
            bad = [n for n in want if n.startswith(folder + "/") and have.get(n) != want[n]]
            if bad:
                raise ValueError(f"{bad[0]} differs from the manifest")
    return spark.read.schema(SCHEMA).parquet(*(f"{root}/data/{f['name']}" for f in listed))


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete the files of data that the manifest doesn't name, and return their names; only while no sync runs."""
    named = {f["name"] for f in manifest(spark, root)["files"]}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    gone = []
    if fs.exists(path):
        files = fs.listFiles(path, True)
        while files.hasNext():
            p = files.next().getPath()
            name = "/".join(str(p.toString()).split("/")[-3:])
            if name not in named and name.startswith("load=") and not p.getName().startswith(("_", ".")):
                fs.delete(p, False)
                gone.append(name)
    return sorted(gone)

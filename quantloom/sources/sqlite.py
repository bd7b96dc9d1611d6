"""SQLite files as a Spark source: read-only, split by ranges of rowid, with filters evaluated by SQLite.

    register(spark)
    spark.read.format("sqlite").option("path", folder).option("table", "catalog").load()

path is a file, or a folder of files with the same table, that all executors can reach. Each file is split into
ranges of `rows` rowids (a table without rowid is one range), so no task reads more than that. Comparisons
with constants, IN, null tests and beginnings, ends and parts of strings go into SQLite's WHERE; what SQLite can't
tell as Spark does stays with Spark.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from quantloom.session import ship

ROWS = 100_000
#: Spark's type of a declared type that begins so; of others, string.
KINDS = {"INT": T.LongType(), "BIGINT": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "BLOB": T.BinaryType()}


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith((".sqlite", ".db")))
    return [path]


def condition(f: D.Filter) -> tuple[str, list] | None:
    """SQL and its values for a filter, None if SQLite might tell rows apart in another way than Spark."""
    if isinstance(f, D.Not):
        inner = condition(f.child) if isinstance(f.child, D.EqualTo) else None
        return inner and (f"NOT ({inner[0]})", inner[1])
    if len(getattr(f, "attribute", ())) != 1:
        return None
    c = quoted(f.attribute[0])
    signs = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
    plain = lambda v: isinstance(v, (str, int)) and not isinstance(v, bool)
    if type(f) in signs and plain(f.value):
        return f"{c} {signs[type(f)]} ?", [f.value]
    if isinstance(f, D.In) and 0 < len(f.value) <= 500 and all(map(plain, f.value)):
        return f"{c} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, D.IsNull):
        return f"{c} IS NULL", []
    if isinstance(f, D.IsNotNull):
        return f"{c} IS NOT NULL", []
    if isinstance(f, D.StringStartsWith):
        return f"substr({c}, 1, length(?)) = ?", [f.value, f.value]
    if isinstance(f, D.StringEndsWith) and f.value:
        return f"substr({c}, -length(?)) = ?", [f.value, f.value]
    if isinstance(f, D.StringContains):
        return f"instr({c}, ?) > 0", [f.value]
    return None


@dataclass
class Range(D.InputPartition):
    file: str
    low: int | None
    high: int | None


class Reader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table, self.rows = schema, options["path"], options["table"], int(options.get("rows", ROWS))
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[D.Filter]):  # noqa: N802
        for f in filters:
            found = condition(f)
            if found is None:
                yield f
            else:
                self.where.append(found)

    def partitions(self) -> list[Range]:
        out = []
        for file in files_of(self.path):
            with opened(file) as c:
                try:
                    low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                except sqlite3.OperationalError as e:
                    if "rowid" not in str(e):
                        raise
                    out.append(Range(file, None, None))
                    continue
            if low is not None:
                out += [Range(file, k, min(k + self.rows - 1, high)) for k in range(low, high + 1, self.rows)]
        return out

    def statement(self, p: Range) -> tuple[str, list]:
        tests = [*self.where, *([("rowid BETWEEN ? AND ?", [p.low, p.high])] if p.low is not None else [])]
        where = " AND ".join(f"({sql})" for sql, _ in tests)
        return f"SELECT {', '.join(map(quoted, self.schema.names))} FROM {quoted(self.table)}" + (f" WHERE {where}" if where else ""), [v for _, vs in tests for v in vs]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # there is nothing to read
            return
        with opened(partition.file) as c:
            yield from c.execute(*self.statement(partition))


class SqliteSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with opened(files_of(self.options["path"])[0]) as c:
            columns = c.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"there is no table {self.options['table']}")
        kind = lambda declared: next((t for k, t in KINDS.items() if declared.upper().startswith(k)), T.StringType())
        return T.StructType([T.StructField(c[1], kind(c[2])) for c in columns])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def read(spark: SparkSession, path: str, table: str, rows: int = ROWS) -> DataFrame:
    register(spark)
    return spark.read.format("sqlite").options(path=path, table=table, rows=rows).load()


def write(df: DataFrame, folder: str, table: str, index: list[str] | None = None) -> None:
    """A SQLite file of the table for each partition of df, in a folder that all executors share; indexed by the given columns.

    A file is made beside its task and moved over when it is whole, so a reader sees no half of one.
    """
    folder = folder.removeprefix("file://").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    kinds = {"bigint": "BIGINT", "int": "INT", "smallint": "INT", "double": "DOUBLE", "float": "DOUBLE", "binary": "BLOB"}
    names, declared = df.columns, [f"{quoted(n)} {kinds.get(t, 'TEXT')}" for n, t in df.dtypes]

    def put(batches):
        local = tempfile.mkdtemp()
        made = os.path.join(local, "part.sqlite")
        n = 0
        with sqlite3.connect(made) as c:
            c.execute(f"CREATE TABLE {quoted(table)} ({', '.join(declared)})")
            for b in batches:
                n += len(b)
                c.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(names))})", zip(*(x.to_pylist() for x in b.columns), strict=True))
            for k in index or []:
                c.execute(f"CREATE INDEX {quoted(f'by_{k}')} ON {quoted(table)} ({quoted(k)})")
        c.close()
        name = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.sqlite")
        part = f"{name}.{uuid.uuid4().hex}.part"
        shutil.move(made, part)
        os.replace(part, name)
        shutil.rmtree(local)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["rows"])

    df.mapInArrow(put, "rows long").write.format("noop").mode("overwrite").save()

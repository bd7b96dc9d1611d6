"""Documents and reports beside the tables: JSON that is replaced whole, metric lines, file listings, Markdown tables."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a report takes to the driver at most; reports are made of factors, windows and folds, not of data.
MOST_ROWS = 10_000


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def write_json(spark: SparkSession, path: str, payload) -> None:
    """Write a JSON document under another name first and move it over, so that a reader sees the old or the new one."""
    fs, target = _file_system(spark, path)
    _, part = _file_system(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps(payload, ensure_ascii=False, indent=1, default=str).encode()))
    finally:
        out.close()
    if not fs.rename(part, target):
        fs.delete(target, False)
        if not fs.rename(part, target):
            raise OSError(f"{path} can't be replaced")


def read_json(spark: SparkSession, path: str, default=None):
    """The document, or the default where there is none; one that is no JSON is set aside as path.corrupt."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return default
    text = spark.read.text(path, wholetext=True).first()
    try:
        return json.loads(text[0] if text else "")
    except ValueError:
        _, aside = _file_system(spark, f"{path}.corrupt")
        fs.delete(aside, False)
        fs.rename(p, aside)
        return default


def append_metrics(events: DataFrame, path: str) -> None:
    """Append rows (event, …) as JSON lines with the time of writing; fields without a value are left out."""
    events.withColumn("ts", F.lit(datetime.datetime.now(datetime.UTC).isoformat())).write.mode("append").json(path)


def files_under(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, modified of all files of the tree whose name fits; no file is read. An absent root has none."""
    fs, p = _file_system(spark, root)
    if not fs.exists(p):
        return spark.createDataFrame([], "path string, length long, modified timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).orderBy("path")


def _rows(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report of more than {MOST_ROWS} rows")
    return rows


def markdown(header: list[str], rows: list[list]) -> str:
    """A table; a pipe or a line end in a cell doesn't break it, no value is a dash."""
    cell = lambda x: "–" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    line = lambda cells: f"| {' | '.join(cells)} |"
    return "\n".join([line(header), line(["---"] * len(header)), *(line([cell(x) for x in r]) for r in rows)])


def bench_report(table: DataFrame, bps: float, metrics: tuple[str, ...] = ("ic", "rank_ic", "icir", "sharpe")) -> str:
    """A row for each factor and metric with a column for each window, at one cost."""
    rows = _rows(table.where(F.col("bps") == bps))
    windows = sorted({r["window"] for r in rows})
    by = {(r["factor"], r["window"]): r for r in rows}
    value = lambda f, w, m: by[f, w][m] if (f, w) in by else None
    return markdown(["factor", "metric", *windows], [[f, m, *(value(f, w, m) for w in windows)] for f in sorted({r["factor"] for r in rows}) for m in metrics])


def cost_report(table: DataFrame) -> str:
    """A row for each cost and factor with Sharpe ratio and annual return of each window."""
    rows = _rows(table)
    windows = sorted({r["window"] for r in rows})
    by = {(r["bps"], r["factor"], r["window"]): r for r in rows}
    keys = sorted({(r["bps"], r["factor"]) for r in rows})
    value = lambda b, f, w, m: by[b, f, w][m] if (b, f, w) in by else None
    return markdown(["bps", "factor", *(f"{w} {m}" for m in ("sharpe", "annual") for w in windows)], [[b, f, *(value(b, f, w, m) for m in ("sharpe", "annual") for w in windows)] for b, f in keys])


def fold_report(summary: DataFrame) -> str:
    """A row for each factor: mean ± spread over folds."""
    both = lambda r, k: None if r[f"{k}_mean"] is None else f"{r[f'{k}_mean']} ± {'–' if r[f'{k}_std'] is None else r[f'{k}_std']}"
    return markdown(["factor", "folds", "ic", "rank_ic", "rank_ic > 0", "sharpe"], [[r["factor"], r["folds"], both(r, "ic"), both(r, "rank_ic"), r["positive_share"], both(r, "sharpe")] for r in _rows(summary.orderBy("factor"))])


def write_sweep(table: DataFrame, root: str, name: str, provenance: dict, top: int = 20) -> str:
    """Write all rows of a ranked sweep (factor, rank, …) with where they come from as name.json, the first as name.md; returns that."""
    spark = table.sparkSession
    rows = [r.asDict(recursive=True) for r in _rows(table.orderBy("rank"))]
    write_json(spark, f"{root}/{name}.json", {"provenance": provenance, "rows": rows})
    columns = ["rank", "factor", *(c for c in table.columns if c not in ("rank", "factor"))]
    text = "\n".join([f"# {name}", "", *(f"- {k}: {v}" for k, v in provenance.items()), "", markdown(columns, [[r[c] for c in columns] for r in rows[:top]])])
    fs, p = _file_system(spark, f"{root}/{name}.md")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    return text


def drift(expected: DataFrame, found: DataFrame, key: str, measures: list[str], counts: list[str] = (), tolerance: float = 1e-6) -> DataFrame:
    """key, match: whether each expected row is found again, measures within the tolerance (or null both times) and counts the same."""
    e, f = expected.alias("e"), found.alias("f")
    close = lambda c: F.coalesce(F.abs(F.col(f"e.{c}") - F.col(f"f.{c}")) <= tolerance, F.col(f"e.{c}").isNull() & F.col(f"f.{c}").isNull())
    ok = F.col(f"f.{key}").isNotNull()
    for c in measures:
        ok = ok & close(c)
    for c in counts:
        ok = ok & F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}"))
    return e.join(f, F.col(f"e.{key}") == F.col(f"f.{key}"), "left").select(F.col(f"e.{key}").alias(key), ok.alias("match"))

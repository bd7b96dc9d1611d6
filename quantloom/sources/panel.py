"""Panels of per-asset, per-date bars, constituents and their files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ["trade_date", "ts_code", "open", "high", "low", "close", "volume", "amount"]
SCHEMA = "trade_date date, ts_code string, open double, high double, low double, close double, volume double, amount double"
# The names that a date and a code column may have.
DATE_NAMES = ("trade_date", "datetime", "date", "time", "timestamp")
CODE_NAMES = ("ts_code", "instrument", "symbol", "ticker", "asset", "order_book_id", "code")
THIN_ASSETS, THIN_DAYS = 50, 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_of(items: DataFrame, asset: Column, period: str = "month") -> DataFrame:
    """Bars of line items by asset and month (or week), in whole cents, so that sums don't depend on their order."""
    cents, quantity = F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long")
    rows = items.select(asset.cast("string").alias("ts_code"), F.trunc("l_shipdate", period).alias("trade_date"), cents.alias("cents"), quantity.alias("qty"))
    unit = F.expr("cents div qty")
    bars = rows.groupBy("trade_date", "ts_code").agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty"), F.max(unit).alias("hi"), F.min(unit).alias("lo"))
    return bars.select(
        "trade_date",
        "ts_code",
        F.expr("(hi + lo) div 2").cast("double").alias("open"),
        F.col("hi").cast("double").alias("high"),
        F.col("lo").cast("double").alias("low"),
        F.expr("cents div qty").cast("double").alias("close"),
        F.col("qty").cast("double").alias("volume"),
        F.col("cents").cast("double").alias("amount"),
    )


def brand_panel(spark: SparkSession, sf_dir: str, period: str = "month") -> DataFrame:
    """Brand by month (or week): 25 assets at every scale."""
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return bars_of(table(spark, sf_dir, "lineitem").join(brands, "l_partkey"), F.col("p_brand"), period)


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by month; the number of assets grows with the data."""
    return bars_of(table(spark, sf_dir, "lineitem"), F.col("l_suppkey"))


def normalised(df: DataFrame) -> DataFrame:
    """Any panel with one of the known date and code columns (case doesn't matter) in the canonical columns; missing fields are null."""
    by_name = {c.lower(): c for c in df.columns}
    date = next((by_name[c] for c in DATE_NAMES if c in by_name), None)
    code = next((by_name[c] for c in CODE_NAMES if c in by_name), None)
    if date is None or code is None:
        raise ValueError(f"a panel needs a date and a code column; it has {df.columns}")
    value = lambda c: F.col(by_name[c]).cast("double") if c in by_name else F.lit(None).cast("double")
    return df.select(F.col(date).cast("date").alias("trade_date"), F.col(code).cast("string").alias("ts_code"), *(value(c).alias(c) for c in FIELDS[2:]))


def stats(panel: DataFrame) -> DataFrame:
    n = panel.agg(F.count_distinct("ts_code").alias("n_assets"), F.count_distinct("trade_date").alias("n_days"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))
    return n.withColumn("thin", (F.col("n_assets") < THIN_ASSETS) | (F.col("n_days") < THIN_DAYS))


def default_universe(stats_row) -> str:
    """A thin local panel is its own universe."""
    return "local_panel" if stats_row is None or stats_row["thin"] else "csi300"


# The window where nothing else is known.
WINDOW = ("2024-01-02", "2024-03-29")


def default_window(stats_row, start: str | None = None, end: str | None = None) -> tuple[str, str]:
    """What is asked for, else the panel's first and last day, else WINDOW; each end by itself."""
    known = (None, None) if stats_row is None else (stats_row["first_day"], stats_row["last_day"])
    return tuple(asked or (str(day)[:10] if day is not None else fixed) for asked, day, fixed in zip((start, end), known, WINDOW, strict=True))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def write_years(panel: DataFrame, root: str) -> None:
    """One directory a year, and a manifest of file digests; a reader can prune by year and check integrity."""
    panel.withColumn("year", F.year("trade_date")).repartition("year").write.mode("overwrite").partitionBy("year").parquet(f"{root}/panel")
    digests(panel.sparkSession, f"{root}/panel").coalesce(1).write.mode("overwrite").json(f"{root}/manifest")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name (from the year directory on), sha256 of every data file under path; files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_extract("path", r"(year=\d+/[^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def read_years(spark: SparkSession, root: str, start: int, end: int, verify: bool = True) -> DataFrame:
    """Whole years from start to end; fails if any year is missing, and if a file isn't the one in the manifest."""
    missing = []
    for year in range(start, end + 1):
        fs, p = _fs(spark, f"{root}/panel/year={year}")
        if not fs.exists(p):
            missing.append(year)
    if missing:
        raise FileNotFoundError(f"years without data: {', '.join(map(str, missing))}")
    if verify:
        fs, p = _fs(spark, f"{root}/manifest")
        if not fs.exists(p):
            raise ValueError("there is no manifest to check the files against")
        wanted = F.regexp_extract("name", r"year=(\d+)/", 1).cast("int").between(start, end)
        listed = spark.read.schema("name string, sha256 string").json(f"{root}/manifest").where(wanted)
        found = digests(spark, f"{root}/panel").where(wanted)
        bad = found.exceptAll(listed).union(listed.exceptAll(found))
        if row := bad.first():
            raise ValueError(f"{row['name']} differs from the manifest")
    panel = spark.read.parquet(f"{root}/panel").where(F.col("year").between(start, end)).select(*FIELDS)
    if panel.isEmpty():
        raise ValueError("the panel is empty")
    return panel


def year_cover(panel: DataFrame, start: int, end: int) -> DataFrame:
    """year, n_rows, complete for every year from start to end."""
    have = panel.groupBy(F.year("trade_date").alias("year")).agg(F.count("*").alias("n_rows"))
    want = panel.sparkSession.range(start, end + 1).select(F.col("id").cast("int").alias("year"))
    return want.join(have, "year", "left").select("year", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.col("n_rows").isNotNull().alias("complete"))


def constituents(panel: DataFrame, members: int = 20, months: int = 6) -> DataFrame:
    """asof, ts_code: at each June and December, the assets with the largest volume of the months before."""
    # Each bar belongs to the snapshots of the next `months` months, so no range join is needed.
    later = F.explode(F.transform(F.sequence(F.lit(1), F.lit(months)), lambda k: F.add_months("trade_date", k)))
    rank = F.row_number().over(Window.partitionBy("asof").orderBy(F.desc("v"), "ts_code"))
    last = panel.agg(F.max("trade_date").alias("last"))
    rows = panel.select("ts_code", "volume", later.alias("asof")).where(F.month("asof").isin(6, 12)).crossJoin(F.broadcast(last)).where("asof <= last")
    sums = rows.groupBy("asof", "ts_code").agg(F.sum("volume").alias("v"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= members).select("asof", "ts_code")


def write_constituents(snapshots: DataFrame, root: str) -> None:
    snapshots.repartition("asof").sortWithinPartitions("ts_code").write.mode("overwrite").partitionBy("asof").parquet(root)


def read_constituents(spark: SparkSession, root: str) -> DataFrame:
    """asof from the directory names; names that hold no date are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema("ts_code string").parquet(root)
    asof = F.try_to_date(F.regexp_extract(F.col("_metadata.file_path"), r"asof=([^/]+)/", 1))
    return files.select(asof.alias("asof"), "ts_code").where("asof IS NOT NULL")


def flattened(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("ts_code").distinct().orderBy("ts_code")


def file_sha256(chunks: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for c in chunks:
        h.update(c)
    return h.hexdigest()


def mapped_fields(text: str) -> list[str]:
    return sorted({f for f in re.findall(r"\$?\b(open|high|low|close|volume|amount|vwap)\b", text.lower())})

"""Structured Streaming extensions: bars from an event stream, and a catalog kept up to date by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quantloom.operators.records import upserted


def bars(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """trade_date, ts_code, open, high, low, close, volume, amount of events (ts, event_type, value) by window; late rows count within the watermark.

    open and close are the values of the first and last event of the window.
    """
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every), F.col("event_type").alias("ts_code"))
    out = w.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("amount"))
    return out.select(F.col("window.start").cast("date").alias("trade_date"), "ts_code", "open", "high", "low", "close", "volume", "amount")


def keep_catalog(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Upsert a stream of catalog entries into versions of a Parquet table under path; a version is complete when its directory is committed."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [] if number == 0 else [spark.read.parquet(f"{path}/v={number - 1}")]
        new = upserted(before[0], batch) if before else upserted(batch.limit(0), batch)
        new.write.mode("overwrite").parquet(f"{path}/v={number}")

    return entries.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

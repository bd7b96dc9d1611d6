"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from quantloom.catalog_of_queries import QUERIES
from quantloom.operators import evaluation as E
from quantloom.operators import pool, records, scores
from quantloom.plans.record_queries import pool_factors, pool_series
from quantloom.session import make_session, saved
from quantloom.sources import panel as P


def sweep(spark, d):
    """The whole grid of 145 candidates over the supplier panel: scores, daily IC and summary in one job."""
    p = P.supplier_panel(spark, d)
    rows = scores.score_many(p, scores.sweep_grid(), with_forward=True).dropna(subset=["score", "fwd"])
    return E.ic_summary(E.daily_ic(rows))


def one_factor(spark, d):
    p = P.supplier_panel(spark, d)
    rows = scores.score_many(p, [("rev", "close", 5)], with_forward=True).dropna(subset=["score", "fwd"])
    return E.net_metrics(E.long_short(rows), ["factor"], F.lit(5.0))


def pool_tables(spark, d):
    """100 candidates and their return series, written before a clock starts."""
    few = spark.createDataFrame([(f"p{k}",) for k in range(100)], "name string")
    factors = pool_factors(spark, d).join(F.broadcast(few), "name").withColumn("ic", F.lit(0.02))
    series = pool_series(spark, d).join(F.broadcast(few.withColumnRenamed("name", "series_id")), "series_id")
    return saved(factors, "factors"), saved(series, "series")


def cull_times(spark, d) -> dict[str, float]:
    """Seconds of a cull of 100 candidates on written series, and of its pass alone over ready correlations."""
    factors, series = pool_tables(spark, d)
    t = time.time()
    pool.pool_cull(factors, series)
    whole = time.time() - t
    rows = factors.where("NOT simulated").orderBy(F.desc("score"), "name").collect()
    pairs = pool.close_pairs([r["name"] for r in rows], series)
    t = time.time()
    pool.kept_in_order(rows, pairs)
    return {"pool_cull_100": round(whole, 3), "pool_pass_100": round(time.time() - t, 5)}


def catalog_rebuild(spark, d):
    """10,000 entries upserted over a catalog that has a third of them."""
    rows = spark.range(10_000).select(F.lit("store").alias("source"), F.col("id").alias("source_ref"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"), F.lit("name").alias("name"))
    return records.upserted(rows.where("source_ref % 3 = 0"), rows.withColumn("updated_at", F.lit(2)))


HEADLINE = {"sweep_145_suppliers": sweep, "one_factor_suppliers": one_factor, "catalog_rebuild_10000": catalog_rebuild} | {n: QUERIES[n] for n in ("daily_ic", "bench_table", "cost_curve", "walkforward", "combine_daily", "neutralize_2", "catalog_upsert", "motif_weights")}


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = make_session("bench", cpus, **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    QUERIES["daily_ic"](spark, d).count()  # compile and warm up
    for name, f in HEADLINE.items():
        t = time.time()
        f(spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    took |= cull_times(spark, d)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d).removeprefix("sf"), "candidates_per_second": round(145 / took["sweep_145_suppliers"], 2)}))


if __name__ == "__main__":
    main()

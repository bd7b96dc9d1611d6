"""Connected groups of linked rows, and running totals over a whole table, without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.session import dropped, saved

MOST_ROUNDS = 60


def groups(links: DataFrame) -> DataFrame:
    """node, group (its smallest node) of all nodes of the links (a, b).

    Every node takes the smallest group among its neighbours', and then the group of that group, until nothing
    changes; the rounds grow with the logarithm of the longest path.
    """
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    own = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("group")), "groups")
    for _ in range(MOST_ROUNDS):
        near = both.join(own.select(F.col("node").alias("b"), "group"), "b").groupBy(F.col("a").alias("node")).agg(F.min("group").alias("near"))
        low = own.join(near, "node").select("node", F.least("group", "near").alias("low"), F.col("group").alias("before"))
        up = own.select(F.col("node").alias("low"), F.col("group").alias("up"))
        new = saved(low.join(up, "low").select("node", F.least("low", "up").alias("group"), (F.least("low", "up") < F.col("before")).alias("moved")), "groups")
        dropped(own)
        own = new
        if own.where("moved").isEmpty():
            dropped(both)
            return own.select("node", "group")
    raise RuntimeError("groups did not settle")


def running_total(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all rows up to each in the given order, of distinct values.

    Rows are dealt by ranges of the order; one number a range, the sum before it, goes through the driver.
    """
    part = f"{name}_part"
    ranged = rows.withColumn(name, value.cast("long")).repartitionByRange(order).withColumn(part, F.spark_partition_id())
    ranged = saved(ranged, "ranged")
    sums = {r[part]: r["s"] for r in ranged.groupBy(part).agg(F.sum(name).alias("s")).collect()}
    total, before = 0, []
    for p in sorted(sums):
        before.append((p, total))
        total += sums[p] or 0
    offsets = rows.sparkSession.createDataFrame(before, f"{part} int, offset long")
    inside = F.sum(name).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(offsets), part).withColumn(name, inside + F.col("offset")).drop(part, "offset")

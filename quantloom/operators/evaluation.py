"""Cross-sectional evaluation: information coefficients, quantile legs, turnover, windows, costs and sweeps.

Frames carry a `factor` column, so any number of factors is evaluated in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import scores

IC_LEAST, GROUPS, DAYS_LEAST, YEAR = 10, 5, 20, 252


def intervals(snapshots: DataFrame) -> DataFrame:
    """asof, until, ts_code: each snapshot holds until the next one."""
    dates = snapshots.select("asof").distinct()
    until = F.lead("asof").over(Window.orderBy("asof"))  # a row for each rebalance date
    return snapshots.join(F.broadcast(dates.withColumn("until", until)), "asof")


def point_in_time(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The rows whose asset is in the latest snapshot on or before the date; dates before the first one go."""
    i = intervals(snapshots)
    inside = (rows["ts_code"] == i["ts_code"]) & (rows["trade_date"] >= i["asof"]) & (i["until"].isNull() | (rows["trade_date"] < i["until"]))
    return rows.join(i, inside, "left_semi")


def scoped(days: DataFrame, start: str, end: str, embargo: bool = True) -> DataFrame:
    """Dates inside the window; with more than one, the last is left out, as its forward return reaches beyond."""
    inside = days.select("trade_date").distinct().where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if not embargo:
        return inside
    ends = inside.agg(F.max("trade_date").alias("last"), F.count("*").alias("n"))
    return inside.crossJoin(F.broadcast(ends)).where((F.col("n") == 1) | (F.col("trade_date") < F.col("last"))).select("trade_date")


def aligned(scores: DataFrame, forwards: DataFrame) -> DataFrame:
    return scores.join(forwards, ["trade_date", "ts_code"]).dropna(subset=["score", "fwd"])


def _ic(x: str, y: str) -> Column:
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when((F.count("*") >= IC_LEAST) & (spread > 0), F.covar_pop(x, y) / F.when(spread > 0, spread))


def _average_rank(x: str, day: list[str]) -> Column:
    w = Window.partitionBy(*day).orderBy(x)
    # Peers by a range frame, so that both share one sort.
    return F.rank().over(w) + (F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


def daily_ic(rows: DataFrame) -> DataFrame:
    """factor, trade_date, ic, rank_ic, n of aligned member rows; dates with few members or no spread have none.

    As in the reference definition, ic is the population covariance over the sample deviations.
    """
    day = ["factor", "trade_date"]
    ranked = rows.withColumns({"rs": _average_rank("score", day), "rf": _average_rank("fwd", day)})
    out = ranked.groupBy(*day).agg(_ic("score", "fwd").alias("ic"), _ic("rs", "rf").alias("rank_ic"), F.count("*").alias("n"))
    return out


def ic_summary(ic: DataFrame, column: str = "ic") -> DataFrame:
    """factor, days, mean, ratio; null below DAYS_LEAST days."""
    n, mean, sd = F.count(column), F.avg(column), F.stddev_pop(column)
    enough = n >= DAYS_LEAST
    return ic.groupBy("factor").agg(n.alias("days"), F.when(enough, F.round(mean, 6)).alias("mean"), F.when(enough & (sd > 0), F.round(mean / F.when(sd > 0, sd), 4)).alias("ratio"))


def ic_table(ic: DataFrame) -> DataFrame:
    """factor, ic, icir, rank_ic from daily values, in one aggregation; null below DAYS_LEAST days."""
    out = []
    for k, mean_as, ratio_as in (("ic", "ic", "icir"), ("rank_ic", "rank_ic", None)):
        n, mean, sd = F.count(k), F.avg(k), F.stddev_pop(k)
        out.append(F.when(n >= DAYS_LEAST, F.round(mean, 6)).alias(mean_as))
        if ratio_as:
            out.append(F.when((n >= DAYS_LEAST) & (sd > 0), F.round(mean / F.when(sd > 0, sd), 4)).alias(ratio_as))
    return ic.groupBy("factor").agg(*out)


def buckets(rows: DataFrame, groups: int = GROUPS) -> DataFrame:
    """rows with bucket 0 to groups - 1 by ordinal rank of the score; 0 holds the lowest."""
    day = Window.partitionBy("factor", "trade_date")
    rank = F.row_number().over(day.orderBy("score", "ts_code"))
    n = F.count("*").over(day)
    return rows.withColumns({"n": n, "bucket": F.floor((rank - 1) * groups / n).cast("int")})


def long_short(rows: DataFrame, groups: int = GROUPS, direction: int = 1) -> DataFrame:
    """factor, trade_date, ls, turnover of dates with at least 4 members a group.

    The long leg is the lowest bucket (direction -1 turns it around). Turnover is the mean over both
    legs of changed members over members, against the date before; it is null there and after a date
    that was too thin.
    """
    low, high = F.col("bucket") == 0, F.col("bucket") == groups - 1
    b = buckets(rows, groups)
    days = b.groupBy("factor", "trade_date").agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(F.when(low, F.col("fwd"))), F.lit(0.0)).alias("long"),
        F.coalesce(F.avg(F.when(high, F.col("fwd"))), F.lit(0.0)).alias("short"),
        F.collect_set(F.when(low, F.col("ts_code"))).alias("longs"),
        F.collect_set(F.when(high, F.col("ts_code"))).alias("shorts"),
    )
    fine = F.col("n") >= 4 * groups
    order = Window.partitionBy("factor").orderBy("trade_date")
    days = days.withColumns({k: F.when(fine, F.col(k)) for k in ("longs", "shorts")})
    churn = lambda k: (F.size(F.array_except(k, F.lag(k).over(order))) + F.size(F.array_except(F.lag(k).over(order), F.col(k)))) / F.size(k)
    turnover = F.when(F.col("longs").isNotNull() & F.lag("longs").over(order).isNotNull(), (churn("longs") + churn("shorts")) / 2)
    return days.withColumn("turnover", turnover).where(fine).select("factor", "trade_date", (direction * (F.col("long") - F.col("short"))).alias("ls"), "turnover")


def net_metrics(daily: DataFrame, by: list[str], bps: Column) -> DataFrame:
    """days, sharpe, annual, max_drawdown, turnover of ls after costs; null values below DAYS_LEAST days.

    The drawdown is that of the compounded curve from 1 on.
    """
    rows = daily.withColumn("net", F.col("ls") - bps / 10_000 * F.coalesce("turnover", F.lit(0.0)))
    order = Window.partitionBy(*by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nav", F.product(1 + F.col("net")).over(order))
    rows = rows.withColumn("peak", F.greatest(F.lit(1.0), F.max("nav").over(order)))
    n, mean, sd = F.count("*"), F.avg("net"), F.stddev_pop("net")
    enough = n >= DAYS_LEAST
    return rows.groupBy(*by).agg(
        n.alias("days"),
        F.when(enough & (sd > 0), F.round(mean * F.sqrt(F.lit(YEAR)) / F.when(sd > 0, sd), 4)).alias("sharpe"),
        F.when(enough, F.round(mean * YEAR, 6)).alias("annual"),
        F.when(enough, F.round(F.least(F.lit(0.0), F.min(F.col("nav") / F.col("peak") - 1)), 4)).alias("max_drawdown"),
        F.when(enough, F.round(F.avg("turnover"), 4)).alias("turnover"),
    )


def with_costs(daily: DataFrame, costs: list[float]) -> DataFrame:
    """A row of daily for each cost; the costs are part of the plan."""
    return daily.withColumn("bps", F.explode(F.array(*(F.lit(float(c)) for c in costs))))


def in_windows(rows: DataFrame, windows: dict[str, tuple[str, str]], embargo: bool = True) -> DataFrame:
    """rows with a `window` column, in every window that holds them; each window's last date is embargoed."""
    spans = F.explode(F.array(*(F.struct(F.lit(k).alias("window"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for k, (a, b) in windows.items())))
    placed = rows.withColumn("s", spans).where("trade_date BETWEEN s.a AND s.b").withColumn("window", F.col("s.window")).drop("s")
    if not embargo:
        return placed
    ends = placed.groupBy("window").agg(F.max("trade_date").alias("last"), F.min("trade_date").alias("first"))
    return placed.join(F.broadcast(ends), "window").where("trade_date < last OR first = last").drop("first", "last")


def bench(rows: DataFrame, windows: dict[str, tuple[str, str]], costs: list[float]) -> DataFrame:
    """factor, window, bps and all metrics, from one pass over the aligned rows."""
    placed = in_windows(rows, windows)
    keyed = placed.withColumn("factor", F.concat_ws("\u0001", "factor", "window"))
    ic = daily_ic(keyed)
    summary = ic_table(ic)
    metrics = net_metrics(with_costs(long_short(keyed), costs), ["factor", "bps"], F.col("bps"))
    out = metrics.join(summary, "factor", "left")
    parts = F.split("factor", "\u0001")
    return out.withColumns({"factor": parts[0], "window": parts[1]})


def walk_forward(rows: DataFrame, bps: float = 5.0) -> DataFrame:
    """factor, fold (calendar year, its last date embargoed), ic, rank_ic, icir and the metrics after costs of each fold with DAYS_LEAST return days."""
    ends = rows.groupBy(F.year("trade_date").alias("fold")).agg(F.max("trade_date").alias("last"), F.min("trade_date").alias("first"))
    placed = rows.withColumn("fold", F.year("trade_date")).join(F.broadcast(ends), "fold").where("trade_date < last OR first = last")
    keyed = placed.withColumn("factor", F.concat_ws("\u0001", "factor", "fold"))
    metrics = net_metrics(long_short(keyed), ["factor"], F.lit(float(bps))).where(F.col("days") >= DAYS_LEAST)
    parts = F.split("factor", "\u0001")
    return metrics.join(ic_table(daily_ic(keyed)), "factor", "left").withColumns({"factor": parts[0], "fold": parts[1].cast("int")})


def fold_summary(folds: DataFrame) -> DataFrame:
    """factor, folds, mean and spread of ic, rank_ic and sharpe over folds, share of folds with a positive rank_ic."""
    measures = [("ic", "ic"), ("rank_ic", "rank_ic"), ("sharpe", "sharpe")]
    mean_and_spread = [x for k, n in measures for x in (F.round(F.avg(k), 6).alias(f"{n}_mean"), F.when(F.count(k) > 1, F.round(F.stddev_pop(k), 6)).alias(f"{n}_std"))]
    positive = F.round(F.avg(F.when(F.col("rank_ic") > 0, 1.0).when(F.col("rank_ic").isNotNull(), 0.0)), 4)
    return folds.groupBy("factor").agg(F.count("*").alias("folds"), *mean_and_spread, positive.alias("positive_share"))


def top_k(table: DataFrame, rank_by: str, k: int) -> DataFrame:
    """The k rows with the largest metric, one at least; the prefixes oos_ and is_ name the window, without one it is IS."""
    window = "oos" if rank_by.startswith("oos_") else "is"
    metric = rank_by.removeprefix("oos_").removeprefix("is_")
    return table.where(F.lower("window") == window).orderBy(F.col(metric).desc_nulls_last(), "factor").limit(max(1, k))


def sweep(panel: DataFrame, specs: list[tuple[str, str, int]]) -> DataFrame:
    """factor, ok, error, days, mean, ratio of each candidate: those that can be computed in one job, the others as rows that tell why not."""
    wrong = {s: why for s in specs if (why := scores.refused(panel, s)) is not None}
    fine = [s for s in dict.fromkeys(specs) if s not in wrong]
    name = lambda s: "_".join(map(str, s))
    spark = panel.sparkSession
    listed = spark.createDataFrame([(name(s), s not in wrong, wrong.get(s)) for s in dict.fromkeys(specs)], "factor string, ok boolean, error string")
    if not fine:
        return listed.select("*", F.lit(0).cast("long").alias("days"), *(F.lit(None).cast("double").alias(c) for c in ("mean", "ratio")))
    rows = scores.score_many(panel, fine, with_forward=True).dropna(subset=["score", "fwd"])
    return listed.join(ic_summary(daily_ic(rows)), "factor", "left").withColumn("days", F.coalesce("days", F.lit(0)))


def rebalance_dates(spark, start: str, end: str) -> DataFrame:
    """Second Fridays of June and December inside the range."""
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("first"))
    friday = F.date_add(F.next_day(F.date_sub("first", 1), "FRI"), 7)
    dates = months.where(F.month("first").isin(6, 12)).select(friday.alias("rebalance_date"))
    return dates.where(F.col("rebalance_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))

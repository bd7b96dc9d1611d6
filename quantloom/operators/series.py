"""Return series in long form (series_id, d, r): ratios, curves, combination and simple heads."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.session import saved, ship

DAYS_LEAST, YEAR, OVERLAP_LEAST = 20, 252, 10
EULER = 0.5772156649015329
#: Share of the product of two variances under which their determinant is no more than rounding.
COLLINEAR = 1e-11


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _order(key: str = "series_id") -> Window:
    return Window.partitionBy(key).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)


def sharpe(series: DataFrame) -> DataFrame:
    """series_id, sharpe; null below 20 values or without variance."""
    sd = F.stddev_pop("r")
    return series.groupBy("series_id").agg(F.when((F.count("r") >= DAYS_LEAST) & (sd > 0), F.avg("r") * F.sqrt(F.lit(YEAR)) / F.when(sd > 0, sd)).alias("sharpe"))


def equity_curve(series: DataFrame) -> DataFrame:
    return series.where("r IS NOT NULL").withColumn("nav", F.round(F.product(1 + F.col("r")).over(_order()), 6))


def max_drawdown(series: DataFrame) -> DataFrame:
    """Against a peak that starts at 1; 0 or below."""
    nav = series.where("r IS NOT NULL").withColumn("nav", F.product(1 + F.col("r")).over(_order()))
    peak = nav.withColumn("peak", F.greatest(F.lit(1.0), F.max("nav").over(_order())))
    return peak.groupBy("series_id").agg(F.least(F.lit(0.0), F.min(F.col("nav") / F.col("peak") - 1)).alias("max_drawdown"))


def ic_t_stat(ratio: Column, n: Column) -> Column:
    return ratio * F.sqrt(n)


def return_moments(series: DataFrame) -> DataFrame:
    """n, mean, variance, skew and kurtosis (population, not excess) of each series, by centred sums."""
    m = series.groupBy("series_id").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.var_pop("r").alias("variance"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurtosis"))
    ok = F.col("variance") > 1e-12
    return m.select("series_id", "n", "mean", "variance", F.when(ok, F.col("skew")).alias("skew"), F.when(ok, F.col("kurtosis")).alias("kurtosis"))


# Hart's rational approximation of the tail of the normal distribution, in double precision.
TAIL_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
TAIL_BOTTOM = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def normal_cdf(x: Column) -> Column:
    """The distribution function of the standard normal, to about 1e-15."""
    a = F.least(F.abs(x), F.lit(37.0))
    poly = lambda cs: reduce(lambda acc, c: acc * a + c, cs[1:], F.lit(cs[0]))
    far = reduce(lambda acc, k: a + k / acc, (4.0, 3.0, 2.0, 1.0), a + 0.65) * 2.506628274631
    tail = F.exp(-a * a / 2) * F.when(a < 7.07106781186547, poly(TAIL_TOP) / poly(TAIL_BOTTOM)).otherwise(1 / far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def chance_factor(trials: int) -> float:
    """How many standard errors the best of so many trials is expected to reach by chance."""
    normal = NormalDist()
    return (1 - EULER) * normal.inv_cdf(1 - 1 / trials) + EULER * normal.inv_cdf(1 - 1 / (trials * np.e)) if trials > 1 else 0.0


def deflated_sharpe(series: DataFrame, trials: int) -> DataFrame:
    """series_id, dsr: the probability that the Sharpe ratio exceeds what the best of so many trials would show by chance.

    Null below DAYS_LEAST values, without variance, and where the moments give no spread.
    """
    m = return_moments(series).withColumn("ratio", F.when(F.col("variance") > 1e-12, F.col("mean") / F.sqrt("variance")))
    m = m.withColumn("spread", 1 - F.col("skew") * F.col("ratio") + (F.col("kurtosis") - 1) / 4 * F.col("ratio") ** 2)
    root = F.sqrt((F.col("n") - 1) / F.when(F.col("spread") > 0, F.col("spread")))
    dsr = normal_cdf(F.col("ratio") * root - F.lit(chance_factor(trials)))
    return m.select("series_id", F.when((F.col("n") >= DAYS_LEAST) & root.isNotNull(), dsr).alias("dsr"))


def library_score(ic: Column, sharpe_ratio: Column, drawdown: Column, pbo: Column) -> Column:
    clamp = lambda x, a, b: F.greatest(F.lit(float(a)), F.least(F.lit(float(b)), F.coalesce(x, F.lit(0.0))))
    total = 50 + clamp(ic * 200, -20, 20) + clamp(sharpe_ratio * 5, -15, 15) - clamp(F.abs(drawdown) * 20, 0, 15) - clamp(pbo * 25, 0, 20)
    return F.round(clamp(total, 0, 100), 1)


def grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").otherwise("D")


def selection_score(annual: Column, ratio: Column, ic: Column, drawdown: Column, turnover: Column, drag: Column, windows: Column | None = None, oos_ratio: Column | None = None) -> Column:
    """The weighted score; with the number of walk-forward windows and their ratio, two windows move half the ratio's weight to theirs."""
    if windows is not None:
        ratio = F.when((windows >= 2) & oos_ratio.isNotNull(), (ratio + oos_ratio) / 2).otherwise(ratio)
    return 0.35 * annual + 0.35 * ratio + 0.15 * ic - 0.08 * F.abs(drawdown) - 0.04 * turnover - 0.03 * drag


def named_score(scorer: str, **columns: Column) -> dict[str, Column]:
    """The columns of a score by its name: selection_score gives score, library_grade gives score and grade."""
    if scorer == "selection_score":
        return {"score": selection_score(**columns)}
    if scorer == "library_grade":
        score = library_score(**columns)
        return {"score": score, "grade": grade(score)}
    raise ValueError(f"unknown scorer {scorer!r}")


#: Series of a block of the correlation table.
BLOCK = 256


def pairwise(series: DataFrame, least: int = OVERLAP_LEAST, count: int | None = None) -> DataFrame:
    """a, b (a < b), n, corr over common dates; null where a side is flat or few dates are common, no row without a common date.

    Series are packed to arrays over their dates and dealt into blocks of about BLOCK; each pair of
    blocks is one task's matrix products over the dates of its series, so neither a join by date nor
    one task holds all pairs. The number of series is that of factors under comparison, not of rows;
    where it is known, as count, they need not be counted first.
    """
    ship(series.sparkSession)
    packed = series.where("series_id IS NOT NULL AND d IS NOT NULL AND r IS NOT NULL").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_date(F.to_date("d")).alias("d"), "r"))).alias("v"))
    packed = packed.select("series_id", "v.d", "v.r")
    if count is None:
        packed = saved(packed, "series")
        count = packed.count()
    blocks = -(-count // BLOCK) or 1
    own = F.pmod(F.xxhash64("series_id"), F.lit(blocks))
    rows = packed.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    rows = rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    kind = series.schema["series_id"].dataType.simpleString()
    return rows.groupBy("x", "y").applyInPandas(_block_correlations(least), f"a {kind}, b {kind}, n long, corr double")


def _block_correlations(least: int):
    def run(t: pd.DataFrame) -> pd.DataFrame:
        own, ids = (t["own"] == t["x"]).to_numpy(), t["series_id"].to_numpy()
        days = np.unique(np.concatenate(t["d"].to_list()))
        x = np.full((len(t), len(days)), np.nan)
        for k, (d, r) in enumerate(zip(t["d"], t["r"], strict=True)):
            x[k, np.searchsorted(days, d)] = r
        there = ~np.isnan(x)
        # Shifting a series changes no correlation, and keeps the sums of squares small.
        x = np.where(there, x - np.nanmean(x, axis=1, keepdims=True), 0.0)
        m = there.astype(float)
        left = np.flatnonzero(own)
        right = left if t["x"].iloc[0] == t["y"].iloc[0] else np.flatnonzero(~own)
        n = m[left] @ m[right].T
        i, j = np.nonzero(n > 0)
        a, b = left[i], right[j]
        keep = ids[a] < ids[b] if right is left else np.ones(len(a), bool)
        i, j, a, b = i[keep], j[keep], a[keep], b[keep]
        n = n[i, j]
        sums = [(p[left] @ q[right].T)[i, j] / n for p, q in ((x, m), (m, x), (x * x, m), (m, x * x), (x, x))]
        spread = np.sqrt(np.maximum(sums[2] - sums[0] ** 2, 0)) * np.sqrt(np.maximum(sums[3] - sums[1] ** 2, 0))
        fine = (n >= least) & (spread > 1e-18)
        corr = np.where(fine, (sums[4] - sums[0] * sums[1]) / np.where(fine, spread, 1), np.nan)
        swap = ids[a] > ids[b]
        return pd.DataFrame({"a": ids[np.where(swap, b, a)], "b": ids[np.where(swap, a, b)], "n": n.astype(np.int64), "corr": pd.Series(corr).astype(object).where(fine, None)})

    return run


def correlations_with(series: DataFrame, names: list[str], least: int = OVERLAP_LEAST) -> DataFrame:
    """a, b, corr of the named series a with every other one, in one join; the named ones are few and go to every task if they are small."""
    few = series.where(F.col("series_id").isin(names)).select(F.col("series_id").alias("a"), "d", F.col("r").alias("x"))
    spread = F.stddev_pop("x") * F.stddev_pop("r")
    ok = (F.count("*") >= least) & (spread > 1e-18)
    rows = series.join(few, "d").where("x IS NOT NULL AND r IS NOT NULL AND series_id <> a")
    return rows.groupBy("a", F.col("series_id").alias("b")).agg(F.when(ok, F.covar_pop("x", "r") / F.when(spread > 1e-18, spread)).alias("corr"))


def correlation_with(series: DataFrame, name: str, least: int = OVERLAP_LEAST) -> DataFrame:
    """b, corr of every other series with one, as in pairwise."""
    one = series.where(F.col("series_id") == name).select("d", F.col("r").alias("x"))
    spread = F.stddev_pop("x") * F.stddev_pop("r")
    ok = (F.count("*") >= least) & (spread > 1e-18)
    rows = series.where(F.col("series_id") != name).join(one, "d").where("x IS NOT NULL AND r IS NOT NULL")
    return rows.groupBy(F.col("series_id").alias("b")).agg(F.when(ok, F.covar_pop("x", "r") / F.when(spread > 1e-18, spread)).alias("corr"))


def covered_grid(series: DataFrame, min_members: int = 2, share: float = 0.6) -> DataFrame:
    """series_id, d, r on every date that enough members cover (all dates if none is), 0 where a member is missing."""
    members = series.select("series_id").distinct()
    total = members.agg(F.count("*").alias("total"))
    dates = series.groupBy("d").agg(F.count_distinct("series_id").alias("n")).crossJoin(F.broadcast(total))
    enough = F.col("n") >= F.greatest(F.lit(min_members), F.floor(share * F.col("total")))
    some = dates.agg(F.coalesce(F.bool_or(enough), F.lit(False)).alias("some"))
    dates = dates.crossJoin(F.broadcast(some)).where(enough | ~F.col("some")).select("d")
    return dates.crossJoin(F.broadcast(members)).join(series, ["series_id", "d"], "left").select("series_id", "d", F.coalesce("r", F.lit(0.0)).alias("r"))


def inverse_vol_weights(grid: DataFrame, lookback: int = 20, least: int = 5) -> DataFrame:
    """grid with weight w: inverse deviation of the dates before, over its sum; 0 without one."""
    past = Window.partitionBy("series_id").orderBy("d").rowsBetween(-max(least, lookback), -1)
    sd = F.when(F.count("r").over(past) >= least, F.stddev_pop("r").over(past))
    rows = grid.withColumn("inv", F.when(sd > 1e-12, 1 / F.when(sd > 1e-12, sd)))
    total = F.sum("inv").over(Window.partitionBy("d"))
    return rows.withColumn("w", F.coalesce(F.col("inv") / F.nullif(total, F.lit(0.0)), F.lit(0.0))).drop("inv")


def weight_turnover(weights: DataFrame) -> DataFrame:
    """d, turnover: half the absolute change over all members; null on the first date."""
    before = F.lag("w").over(Window.partitionBy("series_id").orderBy("d"))
    return weights.withColumn("step", F.abs(F.col("w") - before)).groupBy("d").agg((F.sum("step") / 2).alias("turnover"))


def combined(series: DataFrame, lookback: int = 20, bps: float = 5.0, least_dates: int = 30) -> DataFrame:
    """d, gross, turnover, net of the inverse-volatility combination; nothing below so many dates."""
    weights = inverse_vol_weights(covered_grid(series), lookback)
    days = weights.groupBy("d").agg(F.sum(F.col("w") * F.col("r")).alias("gross"), F.sum("w").alias("held")).join(weight_turnover(weights), "d")
    cost = F.when(F.col("turnover").isNotNull() & (F.col("held") > 0), F.lit(bps) / 10_000 * F.col("turnover") * 2).otherwise(0.0)
    n = F.count("*").over(Window.partitionBy(F.lit(0)))  # one row a date
    return days.withColumn("n", n).where(F.col("n") >= least_dates).select("d", "gross", "turnover", (F.col("gross") - cost).alias("net"))


def combination_vs_best(series: DataFrame, lookback: int = 20, bps: float = 5.0) -> DataFrame:
    """combo_sharpe, best_sharpe on the combination's dates, and whether the combination is strictly better."""
    series = saved(series, "series")
    net = combined(series, lookback, bps).select(F.lit("combination").alias("series_id"), "d", F.col("net").alias("r"))
    members = covered_grid(series).join(net.select("d"), "d", "left_semi").select("series_id", "d", "r")
    ratios = sharpe(net.unionByName(members))
    is_combo = F.col("series_id") == "combination"
    out = ratios.agg(F.max(F.when(is_combo, F.col("sharpe"))).alias("combo_sharpe"), F.max(F.when(~is_combo, F.col("sharpe"))).alias("best_sharpe"))
    return out.withColumn("beats_best", F.col("combo_sharpe") > F.col("best_sharpe"))


def ols_head(series: DataFrame, least: int = 6) -> DataFrame:
    """series_id, n, and the in-sample coefficients of r on 1 and its two lags, by normal equations; of series with `least` values.

    Where the lags don't determine them (a flat series, one that alternates), they are those of the smallest norm.
    """
    rows = _lagged(series)
    m = rows.groupBy("series_id").agg(F.count("*").alias("n"), *(F.avg(k).alias(f"m_{k}") for k in ("y", "x1", "x2")), F.var_pop("x1").alias("v11"), F.var_pop("x2").alias("v22"), F.covar_pop("x1", "x2").alias("v12"), F.covar_pop("x1", "y").alias("v1y"), F.covar_pop("x2", "y").alias("v2y"))
    c = {k: F.col(k) for k in ("m_y", "m_x1", "m_x2", "v11", "v22", "v12", "v1y", "v2y")}
    m = m.where(F.col("n") >= least - 2)
    spread, means = c["v11"] + c["v22"], c["m_x1"] * c["m_x1"] + c["m_x2"] * c["m_x2"]
    flat = spread <= COLLINEAR**2 * (1 + means)
    det = F.when(~flat & (c["v11"] * c["v22"] - c["v12"] * c["v12"] > COLLINEAR * c["v11"] * c["v22"]), c["v11"] * c["v22"] - c["v12"] * c["v12"])
    # Of one direction (u1, u2) in which the lags vary only the slope along it is determined, of flat lags none; across it, the least norm decides.
    longer = c["v11"] >= c["v22"]
    u1, u2 = F.when(longer, c["v11"]).otherwise(c["v12"]), F.when(longer, c["v12"]).otherwise(c["v22"])
    size = F.sqrt(u1 * u1 + u2 * u2)
    u1, u2 = (F.when(flat, 0.0).otherwise(x / F.nullif(size, F.lit(0.0))) for x in (u1, u2))
    along = F.when(flat, 0.0).otherwise((c["v1y"] * u1 + c["v2y"] * u2) / F.nullif(spread, F.lit(0.0)))
    m = m.withColumns({"u1": u1, "u2": u2, "along": along})
    rest = F.col("m_y") - F.col("along") * (F.col("u1") * F.col("m_x1") + F.col("u2") * F.col("m_x2"))
    # What is left is shared between the constant and the means' part across the direction.
    turn = F.col("u1") * F.col("m_x2") - F.col("u2") * F.col("m_x1")
    w1, w2 = F.when(flat, c["m_x1"]).otherwise(-F.col("u2") * turn), F.when(flat, c["m_x2"]).otherwise(F.col("u1") * turn)
    share = rest / (1 + F.when(flat, means).otherwise(turn * turn))
    full = {"b1": (c["v1y"] * c["v22"] - c["v2y"] * c["v12"]) / det, "b2": (c["v2y"] * c["v11"] - c["v1y"] * c["v12"]) / det}
    poor = {"b1": F.col("along") * F.col("u1") + share * w1, "b2": F.col("along") * F.col("u2") + share * w2}
    m = m.withColumns({k: F.coalesce(full[k], poor[k]) for k in full})
    return m.select("series_id", "n", (F.col("m_y") - F.col("b1") * F.col("m_x1") - F.col("b2") * F.col("m_x2")).alias("b0"), "b1", "b2")


def _lagged(series: DataFrame) -> DataFrame:
    order = Window.partitionBy("series_id").orderBy("d")
    rows = series.where(finite(F.col("r")).isNotNull())
    return rows.select("series_id", "d", F.col("r").alias("y"), F.lag("r", 1).over(order).alias("x1"), F.lag("r", 2).over(order).alias("x2")).where("x2 IS NOT NULL")


def ols_curve(series: DataFrame, least: int = 6) -> DataFrame:
    """series_id, d, pred, pnl, nav: the fitted value of each date, its product with the return, and the compounded curve of these."""
    heads = ols_head(series, least)
    rows = _lagged(series).join(heads, "series_id").withColumn("pred", F.col("b0") + F.col("b1") * F.col("x1") + F.col("b2") * F.col("x2"))
    rows = rows.withColumn("pnl", F.col("pred") * F.col("y"))
    return rows.select("series_id", "d", "pred", "pnl", F.product(1 + F.col("pnl")).over(_order()).alias("nav"))


def head(series: DataFrame, kind: str = "ols") -> DataFrame:
    """series_id, d, pred, pnl, nav of a head of the given kind, ols or gbm; of any other name, that of ols."""
    from quantloom.operators.boosting import boosted_head

    return boosted_head(series) if kind == "gbm" else ols_curve(series)


def portfolio_return(curve: DataFrame) -> DataFrame:
    """series_id, portfolio_return: the last value of nav over the first, less 1; null below two dates or from 0."""
    first, last = F.min_by("nav", "d"), F.max_by("nav", "d")
    return curve.groupBy("series_id").agg(F.when(F.count("*") >= 2, last / F.nullif(first, F.lit(0.0)) - 1).alias("portfolio_return"))


def next_action(event: dict[str, Column]) -> Column:
    """What a research loop works on after its last event: factor or model.

    event: action, ok, has_returns, skip_reason, sharpe_net, portfolio_return of it; action is null
    without one. After a factor that came out with returns the model is next; after a model another
    model as long as the reward (net Sharpe, else the portfolio's return) is above 0 and nothing was
    skipped; otherwise a factor.
    """
    reward = F.coalesce(event["sharpe_net"], event["portfolio_return"])
    fine = lambda c: F.coalesce(c, F.lit(False))
    on = (fine(event["action"] == "factor") & fine(event["ok"]) & fine(event["has_returns"])) | (fine(event["action"] == "model") & (F.coalesce(event["skip_reason"], F.lit("")) == "") & fine(reward > 0))
    return F.when(on, "model").otherwise("factor")


def combine_ready(catalog: DataFrame, series: DataFrame, least: int = 2, limit: int = 50) -> DataFrame | str:
    """The combination of the newest ready entries (id, status, updated_at) that have a series, or the reason why there is none."""
    ready = catalog.where("status = 'ready'").orderBy(F.desc("updated_at"), "id").limit(limit).select(F.col("id").alias("series_id"))
    rows = series.join(F.broadcast(ready), "series_id", "left_semi")
    if rows.select("series_id").distinct().limit(least).count() < least:
        return "insufficient_ready_factors"
    return combined(rows)

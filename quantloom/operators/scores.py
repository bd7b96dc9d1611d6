"""Raw factor templates over a panel, cross-sectional ranks, forward returns and neutralisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.session import ship

TINY = 1e-12


def momentum(f: Column, w: int) -> Column:
    return R.change(f, w)


def reversal(f: Column, w: int) -> Column:
    return -R.change(f, w)


def average_distance(f: Column, w: int) -> Column:
    """Against the mean of the w bars before the current one."""
    return f - R.mean(f, w, -1)


def average_zscore(f: Column, w: int) -> Column:
    return average_distance(f, w) / (R.deviation(f, w, -1) + TINY)


def shock(f: Column, w: int) -> Column:
    return f / (R.mean(f, w, -1) + TINY)


def compression(f: Column, w: int) -> Column:
    """The negative range of the current and the w - 1 bars before."""
    return -(R.highest(f, w) - R.lowest(f, w))


TEMPLATES = {"mom": momentum, "rev": reversal, "ma_dist": average_distance, "zma": average_zscore, "shock": shock, "compression": compression}
SEEDS = {"rank_delta_20": ("mom", "close", 20), "reversal_5": ("rev", "close", 5), "vp_shock": ("shock", "volume", 20)}
#: The grid of a sweep: every template, field and window, but for the compression of amounts.
GRID_FIELDS, GRID_WINDOWS = ["close", "high", "low", "volume", "amount"], [3, 5, 10, 20, 30]


def sweep_grid(fields: list[str] = GRID_FIELDS, windows: list[int] = GRID_WINDOWS) -> list[tuple[str, str, int]]:
    return [(t, f, w) for t in TEMPLATES for f in fields for w in windows if (t, f) != ("compression", "amount")]


def refused(panel: DataFrame, spec: tuple[str, str, int]) -> str | None:
    """Why a candidate can't be computed on this panel, or None."""
    template, field, window = spec
    if template not in TEMPLATES:
        return f"unknown template {template}"
    if field not in panel.columns:
        return f"the panel has no field {field}"
    if not isinstance(window, int) or isinstance(window, bool) or window < 1:
        return f"not a window: {window!r}"
    try:
        kind = panel.select(raw(*spec)).dtypes[0][1]
        if kind.split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
            return f"field {field} holds no numbers"
    except Exception as e:  # noqa: BLE001  what Spark's analysis says of this one must not stop the others
        return str(e).split("\n")[0][:200]
    return None


def raw(template: str, field: str, window: int) -> Column:
    return TEMPLATES[template](F.col(field), window)


def score(panel: DataFrame, template: str, field: str, window: int) -> DataFrame:
    """trade_date, ts_code, score: ordinal rank of the raw value among all assets of the date."""
    rows = panel.select("trade_date", "ts_code", raw(template, field, window).alias("raw"))
    return rows.select("trade_date", "ts_code", R.rank(F.col("raw")).alias("score"))


def score_many(panel: DataFrame, specs: list[tuple[str, str, int]], with_forward: bool = False) -> DataFrame:
    """factor, trade_date, ts_code, score (and fwd) for many factors.

    One shuffle by asset computes all raw values, and the forward return, side by side; one by factor
    and date ranks them. Evaluation by factor and date then needs no further shuffle and no join.
    """
    names = [f"{t}_{f}_{w}" for t, f, w in specs]
    extra = [forward().alias("fwd")] if with_forward else []
    wide = panel.select("trade_date", "ts_code", *extra, *(raw(*s).cast("double").alias(n) for s, n in zip(specs, names, strict=True)))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("factor"), F.col(n).alias("raw")) for n in names)))
    keys = ["trade_date", "ts_code", *(["fwd"] if with_forward else [])]
    long = wide.select(*keys, pairs.alias("p")).select("p.factor", *keys, "p.raw")
    order = Window.partitionBy("factor", "trade_date").orderBy(F.col("raw").asc_nulls_last(), "ts_code")
    score = F.when(F.col("raw").isNotNull(), F.row_number().over(order).cast("double"))
    return long.withColumn("score", score).drop("raw")


def forward() -> Column:
    """The return to the asset's next bar, whenever that is."""
    return R.divided(F.lead("close", 1).over(R.series()), F.col("close")) - 1


def forward_returns(panel: DataFrame) -> DataFrame:
    """trade_date, ts_code, fwd: to the asset's next bar, whenever that is."""
    return panel.select("trade_date", "ts_code", forward().alias("fwd"))


def neutralised(scores: DataFrame, controls: list[str]) -> DataFrame:
    """trade_date, ts_code, score as the residual of a daily least-squares fit on the control columns.

    Up to two controls stay in SQL by normal equations; where these don't determine the fit, and for
    more controls, the minimum-norm solution is computed per date.
    """
    rows = scores.dropna(subset=["score", *controls])
    day = R.day()
    y = F.col("score")
    if not controls:
        return rows.select("trade_date", "ts_code", (y - F.avg(y).over(day)).alias("score"))
    if len(controls) == 1:
        x = F.col(controls[0])
        v = F.var_pop(x).over(day)
        slope = F.when(v > TINY, F.covar_pop(x, y).over(day) / F.when(v > TINY, v)).otherwise(0.0)
        return rows.select("trade_date", "ts_code", (y - F.avg(y).over(day) - slope * (x - F.avg(x).over(day))).alias("score"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        design = np.column_stack([np.ones(len(g)), g[controls].to_numpy(float)])
        beta, *_ = np.linalg.lstsq(design, g["score"].to_numpy(float), rcond=None)
        return pd.DataFrame({"trade_date": g["trade_date"], "ts_code": g["ts_code"], "score": g["score"] - design @ beta})

    by_fit = rows.select("trade_date", "ts_code", "score", *controls)
    if len(controls) > 2:
        ship(scores.sparkSession)
        return by_fit.groupBy("trade_date").applyInPandas(fit, "trade_date date, ts_code string, score double")
    a, b = map(F.col, controls)
    vaa, vbb, vab = F.var_pop(a).over(day), F.var_pop(b).over(day), F.covar_pop(a, b).over(day)
    vay, vby = F.covar_pop(a, y).over(day), F.covar_pop(b, y).over(day)
    fine = (vaa * vbb - vab * vab) > 1e-9 * F.greatest(vaa * vbb, F.lit(TINY))
    det = F.when(fine, vaa * vbb - vab * vab)
    # Collinear controls: the better one alone gives the same residual as the minimum-norm fit.
    ca = F.when(fine, (vay * vbb - vby * vab) / det).otherwise(F.when(vaa >= vbb, vay / F.nullif(vaa, F.lit(0.0))).otherwise(F.lit(0.0)))
    cb = F.when(fine, (vby * vaa - vay * vab) / det).otherwise(F.when(vaa < vbb, vby / F.nullif(vbb, F.lit(0.0))).otherwise(F.lit(0.0)))
    residual = y - F.avg(y).over(day) - F.coalesce(ca, F.lit(0.0)) * (a - F.avg(a).over(day)) - F.coalesce(cb, F.lit(0.0)) * (b - F.avg(b).over(day))
    return rows.select("trade_date", "ts_code", residual.alias("score"))

"""Per-asset windows over time and per-date windows across assets, as Columns.

A rolling value needs a full window: fewer bars, or a null among them, give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


#: Share of a value that is lost in double precision.
ROUNDING = 1e-17


def series() -> WindowSpec:
    return Window.partitionBy("ts_code").orderBy("trade_date")


def day() -> WindowSpec:
    return Window.partitionBy("trade_date")


def lagged(x: Column, n: int) -> Column:
    return F.lag(x, n).over(series())


def change(x: Column, n: int) -> Column:
    return x - lagged(x, n)


def _full(x: Column, n: int, value: Column, last: int = 0) -> Column:
    w = series().rowsBetween(last - n + 1, last)
    return F.when(F.count(x).over(w) == n, value.over(w))


def mean(x: Column, n: int, last: int = 0) -> Column:
    return _full(x, n, F.avg(x), last)


def deviation(x: Column, n: int, last: int = 0) -> Column:
    return _full(x, n, F.stddev_samp(x), last)


def total(x: Column, n: int) -> Column:
    return _full(x, n, F.sum(x))


def highest(x: Column, n: int) -> Column:
    return _full(x, n, F.max(x))


def lowest(x: Column, n: int) -> Column:
    return _full(x, n, F.min(x))


def median(x: Column, n: int) -> Column:
    """The middle value, or the mean of the two in the middle: one sort of the window's values a row, no sketch."""
    w = series().rowsBetween(1 - n, 0)
    ordered = F.array_sort(F.collect_list(x).over(w))
    low, high = (F.try_element_at(ordered, F.lit(k)) for k in ((n + 1) // 2, n // 2 + 1))
    return F.when(F.count(x).over(w) == n, (low + high) / 2)


def smoothed(x: Column, n: int) -> Column:
    """The exponential average of span n over all values so far, which begins with the first; null where x is.

    e = e + 2 / (n + 1) * (x - e). What lies further back than the frame weighs less than a rounding error.
    """
    keep = 1 - 2 / (n + 1)
    frame = 1 if keep <= 0 else math.ceil(math.log(ROUNDING) / math.log(keep))
    values = F.collect_list(x).over(series().rowsBetween(-frame, 0))
    first = F.try_element_at(values, F.lit(1))
    return F.when(x.isNotNull(), F.aggregate(values, first, lambda e, v: e * keep + v * (1 - keep)))


def correlation(x: Column, y: Column, n: int) -> Column:
    """Pearson; null where a side doesn't vary."""
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    w = series().rowsBetween(1 - n, 0)
    spread = F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)
    return F.when((F.count(both).over(w) == n) & (spread > 1e-12), F.covar_pop(x, y).over(w) / F.when(spread > 1e-12, spread))


def rank(x: Column) -> Column:
    """1 to n within the date; ties in the order of assets, nulls stay null."""
    order = Window.partitionBy("trade_date").orderBy(x.asc_nulls_last(), F.col("ts_code"))
    return F.when(x.isNotNull(), F.row_number().over(order).cast("double"))


def standard_score(x: Column) -> Column:
    """Distance from the date's mean in sample deviations; null where the date's values don't vary."""
    spread = F.stddev_samp(x).over(day())
    return F.when(spread > 1e-12, (x - F.avg(x).over(day())) / F.when(spread > 1e-12, spread))


def rank_share(x: Column) -> Column:
    """Average rank within the date over the number of values."""
    w = Window.partitionBy("trade_date").orderBy(x.asc_nulls_last())
    peers = F.count(x).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(w) + (peers - 1) / 2) / F.count(x).over(day()))


def divided(x: Column, y: Column) -> Column:
    return x / F.nullif(y, F.lit(0.0))


def logarithm(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))

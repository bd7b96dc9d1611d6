"""A gradient-boosted head on a series' own lags, fitted anew at every date on what lies before it.

For each series (series_id, d, r) and each date from the (LAGS + LEAST_TRAIN)-th on, a model of squared loss
is fitted on all dates before and predicts that date: ROUNDS trees of DEPTH levels, each a greedy split
search over binned lags. Below LEAST_LEAF * 2 rows no split is possible and the mean is predicted.

The fits of one series differ in how many rows they see only. So STEPS of them, and those of further series up
to CELLS cells, are grown side by side in one task, level by level: every fit is a column, running sums in the order
of each lag give what lies left of every cut, and the split search works on all of them at once, from the second level
on only on the nodes that are large enough to be split. A longer series is dealt out over as many tasks as it has
blocks of STEPS dates. Up to BINS distinct values of a lag each has a bin of its own; to a fit, the bins of values
that it does not see are empty and change nothing. Beyond that, bins hold like many of the values that all fits of
the block see. A cut lies halfway between the values next to it that the fit sees, so nothing looks ahead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.series import finite
from quantloom.session import saved, ship

LAGS, LEAST_TRAIN, LEAST_SERIES = 5, 10, 20
ROUNDS, RATE, DEPTH, LEAST_LEAF, BINS = 100, 0.1, 3, 20, 255
STEPS, BLOCKS_A_TASK, CELLS = 128, 64, 1 << 16
#: Of splits whose gains differ by less than this share, the one of the first lag and lowest value counts; gains below ROUNDING of the sum of squares are none.
NEAR, ROUNDING = 1e-9, 1e-12


def lagged(values: np.ndarray, lags: int = LAGS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the lags 1 to `lags`, and what follows each."""
    n = len(values) - lags
    return np.stack([values[lags - 1 - k : lags - 1 - k + n] for k in range(lags)], axis=1), values[lags:]


def bin_edges(column: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Upper ends of the bins of a column, the last one left out."""
    distinct = np.unique(column)
    if len(distinct) > bins:
        distinct = distinct[np.linspace(0, len(distinct) - 1, bins + 1).astype(np.int64)[1:]]
    return distinct[:-1]


def predictions(x: np.ndarray, y: np.ndarray, steps: np.ndarray, common: int, **how) -> np.ndarray:
    """For each t in steps the prediction of y[t] by a model of the rows before t; where values are many, bins come from the first `common` rows."""
    return side_by_side([(x, y, np.asarray(steps), common)], **how)[0]


def side_by_side(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH, least: int = LEAST_LEAF, bins: int = BINS) -> list[np.ndarray]:
    """predictions() of each block (x, y, steps, common). Every fit of every block is a column of the arrays."""
    base = [np.cumsum(y)[steps - 1] / steps for _, y, steps, _ in blocks]
    own = [np.flatnonzero(steps >= 2 * least) for _, _, steps, _ in blocks]
    used = [k for k in range(len(blocks)) if len(own[k])]
    if not used:
        return base
    # As many columns for each block, the last fit more than once if need be, so that rows of a block's columns are moved as one.
    wide = max(len(own[k]) for k in used)
    ends = np.concatenate([np.pad(blocks[k][2][own[k]], (0, wide - len(own[k])), "edge") for k in used])
    of = np.repeat(np.arange(len(used)), wide)
    n, lags, fits = int(ends.max()) + 1, blocks[used[0]][0].shape[1], len(ends)
    every, live, mine = np.arange(fits), np.arange(n)[:, None] < ends, (np.arange(n)[:, None] < ends).astype(float)
    # By row, lag and block: the lag's value, and the row's place in the order of the lag's bins. By lag, place and block: the row, and whether a bin ends there.
    value, rank = np.zeros((n, lags, len(used))), np.tile(np.arange(n)[:, None, None], (1, lags, len(used)))
    order, stop = np.zeros((lags, n, len(used)), np.int64), np.zeros((lags, n, len(used)), bool)
    rest = np.zeros((n, fits))
    for s, k in enumerate(used):
        x, y, steps, common = blocks[k]
        m = int(steps.max()) + 1
        x = x[:m]
        value[:m, :, s], rest[:m, of == s] = x, y[:m, None] - np.pad(base[k][own[k]], (0, wide - len(own[k])), "edge")
        for j in range(lags):
            code = np.searchsorted(bin_edges(x[:, j] if len(np.unique(x[:, j])) <= bins else x[:common, j], bins), x[:, j], "left")
            rank[np.argsort(code, kind="stable"), j, s] = np.arange(m)
            stop[j, : m - 1, s] = np.diff(np.sort(code)) > 0
    order[...] = np.argsort(rank, axis=0).transpose(1, 0, 2)
    rows, order = order * len(used) + np.arange(len(used)), order[:, :, of]
    left = _left_sums(mine.reshape(-1, wide), rows, 0)
    fine = (stop[:, :, of] & (left >= least) & (ends - left >= least)).any(axis=(0, 2))
    if not fine.any():
        return base
    # No node has a cut outside the places where some root has one.
    low, high = int(fine.argmax()), n - int(fine[::-1].argmax())
    rows, order, stop, left = rows[:, :high], order[:, :high], stop[:, low:high], left[:, low:high]
    root = left, _weights(left, ends, stop[:, :, of], least)
    rest *= mine
    none = ROUNDING * (rest * rest).sum(axis=0)
    total, at_end = np.zeros(fits), (ends, every)
    for _ in range(rounds):
        node = np.zeros((n, fits), np.int64)
        # The nodes that may be split: of which fit, which one, the rows that come there, those that the fit sees of them.
        fit, which, here, seen, size = every, np.zeros(fits, np.int64), None, live, ends
        # All that a fit sees sums to 0.
        mass, (left, weight) = _left_sums(rest.reshape(-1, wide), rows, low), root
        for level in range(depth):
            if level:
                mass -= left * (held.sum(axis=0) / size)
            mass *= mass
            mass *= weight
            gain = mass.reshape(-1, len(fit))
            most = gain.max(axis=0)
            split = np.flatnonzero(most > none[fit])
            if not len(split):
                break
            if len(split) < len(fit):
                fit, which, seen, gain, most = fit[split], which[split], seen[:, split], gain[:, split], most[split]
                here = here if here is None else here[:, split]
            lag, bound = np.divmod((gain >= most - NEAR * most).argmax(axis=0), high - low)
            v, under = value[:, lag, of[fit]], rank[:, lag, of[fit]] <= bound + low
            cut = (np.where(seen & under, v, -np.inf).max(axis=0) + np.where(seen & ~under, v, np.inf).min(axis=0)) / 2
            right = v > cut
            node <<= 1
            for k in np.unique(which):
                some = which == k
                node[:, fit[some]] += right[:, some] if here is None else right[:, some] & here[:, some]
            if level + 1 == depth:
                break
            here = np.concatenate([~right, right] if here is None else [here & ~right, here & right], axis=1)
            fit, which = np.concatenate([fit, fit]), np.concatenate([which << 1, which << 1 | 1])
            seen = here & live[:, fit]
            size = seen.sum(axis=0)
            large = np.flatnonzero(size >= 2 * least)
            if not len(large):
                break
            fit, which, here, seen, size = fit[large], which[large], here[:, large], seen[:, large], size[large]
            held, places = np.where(seen, rest[:, fit], 0.0), order[:, :, fit]
            places = places * len(fit) + np.arange(len(fit))
            mass, left = _left_sums(held.reshape(-1, 1), places, low), _left_sums(seen.reshape(-1, 1), places, low)
            weight = _weights(left, size, stop[:, :, of[fit]], least)
        at = node * fits + every
        count = np.bincount(at.ravel(), mine.ravel(), fits << depth)
        leaf = rate * np.bincount(at.ravel(), rest.ravel(), fits << depth) / np.maximum(count, 1)
        rest -= leaf[at] * mine
        total += leaf[at[at_end]]
    for s, k in enumerate(used):
        base[k][own[k]] += total[s * wide :][: len(own[k])]
    return base


def _left_sums(v: np.ndarray, rows: np.ndarray, low: int) -> np.ndarray:
    """(lag, place, column): running sums, from the place `low` on, of the rows of v that stand at the places of rows (lag, place, group of columns)."""
    v = v.take(rows, axis=0).reshape(*rows.shape[:2], -1)
    if v.shape[2] < 64:
        return v.cumsum(axis=1, dtype=float)[:, low:]
    out = np.empty((v.shape[0], v.shape[1] - low, v.shape[2]))
    v[:, : low + 1].sum(axis=1, out=out[:, 0])
    for k in range(1, out.shape[1]):
        np.add(out[:, k - 1], v[:, low + k], out=out[:, k])
    return out


def _weights(left: np.ndarray, size: np.ndarray, stop: np.ndarray, least: int) -> np.ndarray:
    """By what the square of a cut's sum on the left, less its expected one, gives the gain; 0 where there is no cut or a side is too small."""
    ok = stop & (left >= least) & (size - left >= least)
    return np.where(ok, size / np.where(ok, left * (size - left), 1.0), 0.0)


def _boosted(rows: list) -> pd.DataFrame:
    out, blocks = [], []
    for t in rows:
        d, (x, y), steps = t.d, lagged(np.asarray(t.r, float)), np.arange(t.since, t.until)
        out.append({"d": d[LAGS + t.since : LAGS + t.until], "y": y[steps], "series_id": t.series_id})
        blocks.append((x, y, steps, t.since))
    return pd.concat([pd.DataFrame(o).assign(pred=p) for o, p in zip(out, side_by_side(blocks), strict=True)])[["series_id", "d", "pred", "y"]]


def boosted_head(series: DataFrame) -> DataFrame:
    """series_id, d, pred, pnl, nav: the prediction of each date, its product with the return, and the compounded curve of these.

    Series with fewer than LEAST_SERIES finite values have no rows.
    """
    ship(series.sparkSession)
    rows = series.withColumn("r", finite(F.col("r"))).where("r IS NOT NULL AND d IS NOT NULL")
    packed = rows.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("d", "r"))).alias("v")).where(F.size("v") >= LEAST_SERIES)
    start = F.explode(F.sequence(F.lit(LEAST_TRAIN), F.size("v") - LAGS - 1, F.lit(STEPS)))
    blocks = packed.select("series_id", F.col("v.d").alias("d"), F.col("v.r").alias("r"), start.alias("since"))
    blocks = saved(blocks.withColumn("until", F.least(F.col("since") + STEPS, F.size("r") - LAGS)), "blocks")
    # A block is few bytes and seconds of work, so sizes alone would put all into one task.
    count = blocks.count()
    blocks = blocks.repartition(max(1, count // BLOCKS_A_TASK, min(count, 4 * series.sparkSession.sparkContext.defaultParallelism)), "series_id", "since")
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for t in b.itertuples():
                # The rows and columns that a block has in the arrays.
                size += t.until * (t.until - t.since)
                held.append(t)
                if size >= CELLS:
                    yield _boosted(held)
                    held, size = [], 0
        if held:
            yield _boosted(held)

    out = blocks.mapInPandas(run, f"series_id {kinds['series_id']}, d {kinds['d']}, pred double, y double").withColumn("pnl", F.col("pred") * F.col("y"))
    order = Window.partitionBy("series_id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("series_id", "d", "pred", "pnl", F.product(1 + F.col("pnl")).over(order).alias("nav"))

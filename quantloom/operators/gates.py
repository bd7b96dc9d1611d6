"""Promotion gates over factor records, as one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.functions import expressions as X
from quantloom.operators.series import finite

LEAST_IC, LEAST_T, LEAST_DSR, MOST_SIMILAR = 0.005, 3.0, 0.95, 0.85
MOST_SL, MOST_PC, MOST_FC, MOST_CORR = 40, 6, 8, 0.7
LEAST_ASSETS, PANEL_ASSETS, PANEL_DAYS = 20, 50, 60
OVERRIDABLE = {"thin_panel", "weak_ic", "inflated_sharpe", "homogeneous", "overcomplex"}
# Names of universes that claim a broad market.
BROAD = ["csi300", "csi500", "csi1000", "all", "all_a", "market"]


def thin(n_assets: Column, n_days: Column) -> Column:
    """Under PANEL_ASSETS assets or PANEL_DAYS days, or not known; under LEAST_ASSETS in any case."""
    return F.coalesce((n_assets < LEAST_ASSETS) | (n_assets < PANEL_ASSETS) | (n_days < PANEL_DAYS), F.lit(True))


def failures(record: dict[str, Column], direction: str, override: frozenset[str] = frozenset()) -> Column:
    """Names of the gates that a record fails, in order.

    record: simulated, formula_proxy, n_assets and n_days of its panel (null if they can't be told), ic,
    n_returns, pool_corr and library_corr (the largest correlation with a series of the pool, and of the
    library), corr_error (what went wrong there, or null), code, ic_ir, dsr, similarity, sl, pc, fc.
    """
    if direction not in ("to_pool", "to_library"):
        raise ValueError(direction)
    ic, t = finite(record["ic"]), F.abs(finite(record["ic_ir"]) * F.sqrt(record["n_returns"]))
    pool_only, has_returns = F.lit(direction == "to_pool"), F.coalesce(record["n_returns"], F.lit(0)) > 0
    tests = [
        ("simulated", record["simulated"]),
        ("formula_proxy", record["formula_proxy"]),
        ("thin_panel", thin(record["n_assets"], record["n_days"])),
        ("missing_ic", ic.isNull()),
        ("ic_threshold", pool_only & (F.abs(ic) <= LEAST_IC)),
        ("missing_returns", ~has_returns),
        ("correlated", has_returns & ((record["pool_corr"] > MOST_CORR) | (~pool_only & (record["library_corr"] > MOST_CORR)))),
        ("corr_error", has_returns & record["corr_error"].isNotNull()),
        ("empty_code", pool_only & (F.coalesce(F.trim(record["code"]), F.lit("")) == "")),
        ("weak_ic", has_returns & (t < LEAST_T)),
        ("inflated_sharpe", record["dsr"] < LEAST_DSR),
        ("homogeneous", record["similarity"] > MOST_SIMILAR),
        ("overcomplex", (record["sl"] > MOST_SL) | (record["pc"] > MOST_PC) | (record["fc"] > MOST_FC)),
    ]
    name = lambda n: F.concat(F.lit("corr_error:"), record["corr_error"]) if n == "corr_error" else F.lit(n)
    found = [F.when(F.coalesce(c, F.lit(False)), name(n)) for n, c in tests if n not in override & OVERRIDABLE]
    return F.array_compact(F.array(*found))


def within_tolerance(recorded: Column, again: Column) -> Column:
    """A re-run agrees if it is within 0.01 or 5 % of the recorded value."""
    return F.coalesce(F.abs(again - recorded) <= F.greatest(F.lit(0.01), 0.05 * F.abs(recorded)), F.lit(False))


def claims_broad(universe: Column) -> Column:
    return F.coalesce(F.replace(F.lower(F.trim(universe)), F.lit(" "), F.lit("")).isin(BROAD), F.lit(False))


def expression_gates(text: str, corpus: list[str]) -> list[str]:
    """homogeneous and overcomplex for one expression; what doesn't parse passes."""
    try:
        c, s = X.complexity(X.parse(text)), X.most_similar(text, corpus)
    except ValueError:
        return []
    return ["homogeneous"] * (s > MOST_SIMILAR) + ["overcomplex"] * (c["sl"] > MOST_SL or c["pc"] > MOST_PC or c["fc"] > MOST_FC)



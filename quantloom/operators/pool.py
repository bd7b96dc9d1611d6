"""Order-dependent selection: Spark computes correlations or features, a greedy pass over the few candidates decides."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import expressions as X
from quantloom.operators import series as S

#: Candidates that a greedy pass takes to the driver; these are factors, not rows of data.
MOST_CANDIDATES = 5000


def _few(df: DataFrame) -> list:
    rows = df.limit(MOST_CANDIDATES + 1).collect()
    if len(rows) > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidates for a greedy pass")
    return rows


def correlations(series: DataFrame) -> Callable[[str, str], float | None]:
    """For at most MOST_CANDIDATES series, so at most half the square of that many numbers come to the driver."""
    _few(series.select("series_id").distinct())
    table = S.pairwise(series).toArrow()
    known = dict(zip(zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True), table["corr"].to_pylist(), strict=True))
    return lambda a, b: known.get((min(a, b), max(a, b)))


def structural_dedup(candidates: list[tuple[str, str]], zoo: Iterable[str], most: float = 0.85) -> list[tuple[str, str]]:
    """In order, those whose similarity to the zoo and to all accepted before is at most `most`; what doesn't parse passes."""
    known, out = [X.parse(z) for z in zoo], []
    for name, text in candidates:
        try:
            tree = X.parse(text)
        except ValueError:
            out.append((name, text))
            continue
        if all(X.similarity(tree, k) <= most for k in known):
            known.append(tree)
            out.append((name, text))
    return out


# The metrics whose sign turns with a factor's.
MIRRORED = ["ic", "rank_ic", "sharpe", "ic_ir", "icir", "perf_metric", "selection_score"]


def sign_reflected(factors: DataFrame, least_t: float = 3.0) -> DataFrame:
    """factors (with ic, ic_ir, n_days, has_returns …) and a mirrored row for each with a clearly negative ic.

    Those of MIRRORED that there are change their sign if they are finite; a hypothesis gets a remark.
    sign_reflected tells the rows apart, reflected_from_t has the t value behind it.
    """
    t = F.col("ic_ir") * F.sqrt("n_days")
    base = factors.withColumns({"sign_reflected": F.lit(False), "reflected_from_t": F.lit(None).cast("double")})
    mirror = base.where((F.col("ic") < 0) & S.finite(F.col("ic")).isNotNull() & F.col("has_returns") & (F.abs(t) >= least_t))
    turned = {k: F.when(S.finite(F.col(k)).isNotNull(), -F.col(k)).otherwise(F.col(k)) for k in MIRRORED if k in factors.columns}
    if "hypothesis" in factors.columns:
        turned["hypothesis"] = F.concat("hypothesis", F.lit(" [sign-mirrored]"))
    return base.unionByName(mirror.withColumns(turned | {"sign_reflected": F.lit(True), "reflected_from_t": F.round(t, 3)}))


def pool_cull(factors: DataFrame, series: DataFrame, least_ic: float = 0.005, most_corr: float = 0.7) -> list[str]:
    """Names kept: simulated and weak ones go, then in order of score those correlated with a kept one of their profile.

    Spark finds the pairs that are too close; the pass over the candidates in order needs only these.
    """
    fine = factors.where(~F.col("simulated") & (F.abs("ic") > least_ic))
    rows = _few(fine.orderBy(F.desc("score"), "name"))
    return kept_in_order(rows, close_pairs([r["name"] for r in rows], series, most_corr), most_corr)


def close_pairs(names: list[str], series: DataFrame, most_corr: float = 0.7) -> list[tuple[str, str, float]]:
    """(a, b, corr) of the named series that are too close."""
    wanted = series.join(F.broadcast(series.sparkSession.createDataFrame([(n,) for n in names], "series_id string")), "series_id", "left_semi")
    pairs = S.pairwise(wanted, count=len(names)).where(F.abs("corr") > most_corr).toArrow()
    return list(zip(*(pairs[c].to_pylist() for c in ("a", "b", "corr")), strict=True))


def kept_in_order(rows: list, pairs: list[tuple[str, str, float]], most_corr: float = 0.7) -> list[str]:
    """The pass of the cull over rows (name, ic, profile) in order of their score."""
    place = {r["name"]: k for k, r in enumerate(rows)}
    earlier: list[list[int]] = [[] for _ in rows]
    for a, b, corr in pairs:
        i, j = sorted((place[a], place[b]))
        same_sign = (rows[i]["ic"] >= 0) == (rows[j]["ic"] >= 0)
        if rows[i]["profile"] == rows[j]["profile"] and (corr if same_sign else -corr) > most_corr:
            earlier[j].append(i)
    kept = [False] * len(rows)
    for k in range(len(rows)):
        kept[k] = not any(kept[i] for i in earlier[k])
    return [r["name"] for k, r in enumerate(rows) if kept[k]]


def diverse_samples(factors: DataFrame, series: DataFrame, k: int) -> list[str]:
    """The factor with the largest |ic| first, then each time the one whose largest |corr| to the chosen is smallest.

    Pairs without enough overlap or without variance count as 1. Each choice asks Spark for the
    correlations with the one chosen last, never for those of all pairs.
    """
    rows = _few(factors.where(~F.col("status").isin("deprecated", "culled")).join(series.select(F.col("series_id").alias("name")).distinct(), "name", "left_semi").orderBy(F.desc(F.abs("ic")), "name"))
    names = [r["name"] for r in rows]
    if len(names) < 2:
        return []
    chosen, nearest = [], dict.fromkeys(names, 0.0)
    while len(chosen) < min(k, len(names)):
        chosen.append(min((n for n in names if n not in chosen), key=lambda n: (nearest[n], names.index(n))) if chosen else names[0])
        found = {r["b"]: r["corr"] for r in S.correlation_with(series, chosen[-1]).collect()}
        for n in names:
            nearest[n] = max(nearest[n], 1.0 if found.get(n) is None else abs(found[n]))
    return chosen


def chain_decision(record: tuple[str, float], chains: list[list[tuple[str, float]]], corr: Callable[[str, str], float | None], least: float = 0.7) -> tuple[str, int]:
    """('extend' | 'reject' | 'new', chain): the chain with the most correlated member, extended only by a better rank_ic than all of its members."""
    best, at = 0.0, -1
    for k, chain in enumerate(chains):
        for name, _ in chain:
            c = corr(record[0], name)
            if c is not None and abs(c) >= least and abs(c) > best:
                best, at = abs(c), k
    if at < 0:
        return "new", len(chains)
    return ("extend" if all(record[1] > r for _, r in chains[at]) else "reject"), at

"""Queries of cross-sectional evaluation and of return series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import expressions as X
from quantloom.operators import evaluation as E
from quantloom.operators import scores
from quantloom.operators import series as S
from quantloom.plans.panel_queries import CONSTITUENTS, FORWARD, SEED_SQL, members, ranked
from quantloom.plans.registry import PANEL, SERIES, query
from quantloom.sources import panel as P

WINDOWS = {"IS": ("1996-01-01", "1999-12-31"), "OOS": ("2000-01-01", "2001-12-31")}
COSTS = [0.0, 5.0, 10.0]
SEEDS = list(scores.SEEDS.values())

# Aligned rows of the three seeds for point-in-time members: factor, trade_date, ts_code, score, fwd.
INTERVALS = "iv AS (SELECT c.as_of, ts_code, until FROM cons c JOIN (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS until FROM (SELECT DISTINCT as_of FROM cons)) USING (as_of))"
_NAMES = {"rank_delta_20": "mom_close_20", "reversal_5": "rev_close_5", "vp_shock": "shock_volume_20"}
ROWS = f"""WITH {PANEL}, {CONSTITUENTS}, {INTERVALS},
scores AS ({' UNION ALL '.join(f"SELECT '{_NAMES[k]}' AS factor, * FROM ({ranked(v)})" for k, v in SEED_SQL.items())}),
fwd AS ({FORWARD}),
member AS (SELECT p.trade_date, p.ts_code FROM p SEMI JOIN iv ON p.ts_code = iv.ts_code AND p.trade_date >= as_of AND (until IS NULL OR p.trade_date < until)),
rows AS (SELECT factor, s.trade_date, s.ts_code, score, fwd FROM scores s JOIN fwd f USING (trade_date, ts_code) SEMI JOIN member m ON s.trade_date = m.trade_date AND s.ts_code = m.ts_code WHERE score IS NOT NULL AND fwd IS NOT NULL)"""
IC = """
ranked AS (SELECT *, rank() OVER (PARTITION BY factor, trade_date ORDER BY score) + (count(*) OVER (PARTITION BY factor, trade_date, score) - 1) / 2 AS rs,
  rank() OVER (PARTITION BY factor, trade_date ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, trade_date, fwd) - 1) / 2 AS rf FROM rows),
ic AS (SELECT factor, trade_date, CASE WHEN count(*) >= 10 THEN covar_pop(score, fwd) / nullif(stddev_samp(score) * stddev_samp(fwd), 0) END AS ic,
  CASE WHEN count(*) >= 10 THEN covar_pop(rs, rf) / nullif(stddev_samp(rs) * stddev_samp(rf), 0) END AS rank_ic, count(*) AS n FROM ranked GROUP BY factor, trade_date)"""
LEGS = """
placed AS (SELECT *, count(*) OVER (PARTITION BY factor, trade_date) AS n, row_number() OVER (PARTITION BY factor, trade_date ORDER BY score, ts_code) AS rk FROM rows),
bucketed AS (SELECT *, CAST(floor((rk - 1) * 5 / n) AS INTEGER) AS bucket FROM placed),
days AS (SELECT factor, trade_date, max(n) AS n, coalesce(avg(fwd) FILTER (bucket = 0), 0) - coalesce(avg(fwd) FILTER (bucket = 4), 0) AS ls,
  CASE WHEN max(n) >= 20 THEN list(ts_code) FILTER (bucket = 0) END AS longs, CASE WHEN max(n) >= 20 THEN list(ts_code) FILTER (bucket = 4) END AS shorts FROM bucketed GROUP BY factor, trade_date),
lagged AS (SELECT *, lag(longs) OVER (PARTITION BY factor ORDER BY trade_date) AS pl, lag(shorts) OVER (PARTITION BY factor ORDER BY trade_date) AS ps FROM days),
ls AS (SELECT factor, trade_date, ls, CASE WHEN pl IS NOT NULL THEN
  ((len(list_filter(longs, lambda x: NOT list_contains(pl, x))) + len(list_filter(pl, lambda x: NOT list_contains(longs, x)))) / len(longs)
  + (len(list_filter(shorts, lambda x: NOT list_contains(ps, x))) + len(list_filter(ps, lambda x: NOT list_contains(shorts, x)))) / len(shorts)) / 2 END AS turnover
  FROM lagged WHERE n >= 20)"""


def seed_rows(spark, d, period: str = "month") -> DataFrame:
    """As ROWS: scores of all seeds in one pass, forward returns, members of the time."""
    p = P.brand_panel(spark, d, period)
    rows = scores.score_many(p, SEEDS, with_forward=True).dropna(subset=["score", "fwd"])
    return E.point_in_time(rows, members(p))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


_BASE = f"""WITH {PANEL}, s AS ({ranked(f'close - lag(close, 1) OVER ({SERIES})')}), fwd AS ({FORWARD}),
rows AS (SELECT 'baseline' AS factor, trade_date, ts_code, score, fwd FROM s JOIN fwd USING (trade_date, ts_code) WHERE score IS NOT NULL AND fwd IS NOT NULL), {IC}"""


# The same over suppliers, whose number grows with the data.
_WIDE = _BASE.replace("p_brand AS ts_code", "CAST(l_suppkey AS VARCHAR) AS ts_code").replace("FROM lineitem JOIN part ON l_partkey = p_partkey", "FROM lineitem")


def baseline_rows(spark, d, panel=P.brand_panel) -> DataFrame:
    """The locked baseline: one expression over the panel, all assets."""
    p = panel(spark, d)
    scored = p.select(F.lit("baseline").alias("factor"), "trade_date", "ts_code", X.compiled("Rank(Delta(close, 1))").alias("score"))
    return E.aligned(scored, scores.forward_returns(p))


@query("daily_ic", f"{_BASE} SELECT trade_date, round(ic, 6) + 0.0 AS ic, n FROM ic")
def daily_ic(spark, d):
    return _rounded(E.daily_ic(baseline_rows(spark, d)).select("trade_date", "ic", "n"), "ic")


@query("daily_ic_suppliers", f"{_WIDE} SELECT trade_date, round(ic, 6) + 0.0 AS ic, round(rank_ic, 6) + 0.0 AS rank_ic, n FROM ic")
def daily_ic_suppliers(spark, d):
    return _rounded(E.daily_ic(baseline_rows(spark, d, P.supplier_panel)).select("trade_date", "ic", "rank_ic", "n"), "ic", "rank_ic")


@query("ls_returns_suppliers", f"{_WIDE}, {LEGS} SELECT trade_date, round(ls, 6) + 0.0 AS ls, round(turnover, 6) AS turnover FROM ls")
def ls_returns_suppliers(spark, d):
    out = E.long_short(baseline_rows(spark, d, P.supplier_panel))
    return _rounded(out.select("trade_date", "ls", F.round("turnover", 6).alias("turnover")), "ls")


@query("daily_rank_ic", f"{ROWS}, {IC} SELECT factor, trade_date, round(rank_ic, 6) + 0.0 AS rank_ic, n FROM ic")
def daily_rank_ic(spark, d):
    return _rounded(E.daily_ic(seed_rows(spark, d)).select("factor", "trade_date", "rank_ic", "n"), "rank_ic")


@query("icir", f"{ROWS}, {IC} SELECT factor, count(ic) AS days, CASE WHEN count(ic) >= 20 THEN round(avg(ic), 6) + 0.0 END AS mean, CASE WHEN count(ic) >= 20 THEN round(avg(ic) / nullif(stddev_pop(ic), 0), 4) + 0.0 END AS ratio FROM ic GROUP BY factor")
def icir(spark, d):
    out = E.ic_summary(E.daily_ic(seed_rows(spark, d)))
    return out.withColumns({"mean": F.col("mean") + F.lit(0.0), "ratio": F.col("ratio") + F.lit(0.0)})


@query("join_score_fwd", f"{ROWS} SELECT s.trade_date, s.ts_code, score, round(fwd, 6) AS fwd FROM scores s JOIN fwd USING (trade_date, ts_code) WHERE factor = 'rev_close_5' AND score IS NOT NULL AND fwd IS NOT NULL")
def join_score_fwd(spark, d):
    p = P.brand_panel(spark, d)
    return E.aligned(scores.score(p, "rev", "close", 5), scores.forward_returns(p)).withColumn("fwd", F.round("fwd", 6))


@query("pit_universe", f"WITH {PANEL}, {CONSTITUENTS}, {INTERVALS} SELECT p.trade_date, p.ts_code FROM p JOIN iv ON p.ts_code = iv.ts_code AND p.trade_date >= as_of AND (until IS NULL OR p.trade_date < until)")
def pit_universe(spark, d):
    p = P.brand_panel(spark, d)
    return E.point_in_time(p.select("trade_date", "ts_code"), members(p))


@query("semi_members", f"WITH {PANEL}, {CONSTITUENTS} SELECT trade_date, ts_code, close FROM p WHERE ts_code IN (SELECT ts_code FROM cons WHERE as_of = (SELECT max(as_of) FROM cons))")
def semi_members(spark, d):
    p = P.brand_panel(spark, d)
    m = members(p)
    last = m.agg(F.max("asof").alias("asof"))
    return p.join(m.join(F.broadcast(last), "asof"), "ts_code", "left_semi").select("trade_date", "ts_code", "close")


@query("window_scope", f"WITH {PANEL} SELECT DISTINCT trade_date FROM p WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def window_scope(spark, d):
    return E.scoped(P.brand_panel(spark, d), *WINDOWS["IS"], embargo=False)


@query("embargo_scope", f"WITH {PANEL}, w AS (SELECT DISTINCT trade_date FROM p WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') SELECT trade_date FROM w WHERE trade_date < (SELECT max(trade_date) FROM w) OR (SELECT count(*) FROM w) = 1")
def embargo_scope(spark, d):
    return E.scoped(P.brand_panel(spark, d), *WINDOWS["IS"])


@query("quintile_buckets", f"{ROWS}, {LEGS} SELECT factor, trade_date, ts_code, bucket FROM bucketed")
def quintile_buckets(spark, d):
    return E.buckets(seed_rows(spark, d)).select("factor", "trade_date", "ts_code", "bucket")


@query("ls_returns", f"{ROWS}, {LEGS} SELECT factor, trade_date, round(ls, 6) + 0.0 AS ls FROM ls")
def ls_returns(spark, d):
    return _rounded(E.long_short(seed_rows(spark, d)).select("factor", "trade_date", "ls"), "ls")


@query("ls_turnover", f"{ROWS}, {LEGS} SELECT factor, trade_date, round(turnover, 6) AS turnover FROM ls")
def ls_turnover(spark, d):
    return E.long_short(seed_rows(spark, d)).select("factor", "trade_date", F.round("turnover", 6).alias("turnover"))


def _net(by: str, bps: str, source: str = "ls") -> str:
    """SQL CTEs net, curve and metrics over (factor, …, trade_date, ls, turnover)."""
    return f"""
net AS (SELECT *, ls - {bps} / 10000.0 * coalesce(turnover, 0) AS net FROM {source}),
nav AS (SELECT *, product(1 + net) OVER (PARTITION BY {by} ORDER BY trade_date) AS nav FROM net),
peak AS (SELECT *, greatest(1.0, max(nav) OVER (PARTITION BY {by} ORDER BY trade_date)) AS peak FROM nav),
metrics AS (SELECT {by}, count(*) AS days, CASE WHEN count(*) >= 20 THEN round(avg(net) * sqrt(252) / nullif(stddev_pop(net), 0), 4) + 0.0 END AS sharpe,
  CASE WHEN count(*) >= 20 THEN round(avg(net) * 252, 6) + 0.0 END AS annual, CASE WHEN count(*) >= 20 THEN round(least(0.0, min(nav / peak - 1)), 4) + 0.0 END AS max_drawdown,
  CASE WHEN count(*) >= 20 THEN round(avg(turnover), 4) END AS turnover FROM peak GROUP BY {by})"""


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c) + F.lit(0.0) for c in ("sharpe", "annual", "max_drawdown")})


@query("window_metrics", f"{ROWS}, {LEGS}, {_net('factor', '5.0')} SELECT * FROM metrics")
def window_metrics(spark, d):
    return _plain(E.net_metrics(E.long_short(seed_rows(spark, d)), ["factor"], F.lit(5.0)))


@query("cost_curve", f"{ROWS}, {LEGS}, costs AS (SELECT ls.*, bps FROM ls, (VALUES (0.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE)) c(bps)), {_net('factor, bps', 'bps', 'costs')} SELECT * FROM metrics")
def cost_curve(spark, d):
    return _plain(E.net_metrics(E.with_costs(E.long_short(seed_rows(spark, d)), COSTS), ["factor", "bps"], F.col("bps")))


# Folds need DAYS_LEAST return dates a year, so they are made on weekly bars.
WEEKLY = ROWS.replace("date_trunc('month'", "date_trunc('week'")
ICS = """ics AS (SELECT factor, CASE WHEN count(ic) >= 20 THEN round(avg(ic), 6) + 0.0 END AS ic, CASE WHEN count(ic) >= 20 THEN round(avg(ic) / nullif(stddev_pop(ic), 0), 4) + 0.0 END AS icir,
  CASE WHEN count(rank_ic) >= 20 THEN round(avg(rank_ic), 6) + 0.0 END AS rank_ic FROM ic GROUP BY factor)"""
_FOLDS = f"""{WEEKLY.replace('rows AS (SELECT factor', 'every AS (SELECT factor')},
last_days AS (SELECT year(trade_date) AS y, max(trade_date) AS last, min(trade_date) AS first FROM every GROUP BY 1),
rows AS (SELECT factor || '@' || y AS factor, trade_date, ts_code, score, fwd FROM every JOIN last_days ON year(trade_date) = y WHERE trade_date < last OR first = last),
{IC}, {LEGS}, {_net('factor', '5.0')}, {ICS},
folds AS (SELECT split_part(m.factor, '@', 1) AS factor, CAST(split_part(m.factor, '@', 2) AS INTEGER) AS fold, days, sharpe, annual, max_drawdown, turnover, ic, icir, rank_ic FROM metrics m LEFT JOIN ics ON m.factor = ics.factor WHERE days >= 20)"""


def _folds(spark, d) -> DataFrame:
    out = _plain(E.walk_forward(seed_rows(spark, d, "week")))
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in ("ic", "icir", "rank_ic")})


@query("walkforward", f"{_FOLDS} SELECT * FROM folds")
def walkforward(spark, d):
    return _folds(spark, d)


@query("walkforward_summary", f"""{_FOLDS} SELECT factor, count(*) AS folds, round(avg(ic), 6) + 0.0 AS ic_mean, CASE WHEN count(ic) > 1 THEN round(stddev_pop(ic), 6) END AS ic_std,
  round(avg(rank_ic), 6) + 0.0 AS rank_ic_mean, CASE WHEN count(rank_ic) > 1 THEN round(stddev_pop(rank_ic), 6) END AS rank_ic_std,
  round(avg(sharpe), 6) + 0.0 AS sharpe_mean, CASE WHEN count(sharpe) > 1 THEN round(stddev_pop(sharpe), 6) END AS sharpe_std,
  round(avg(CASE WHEN rank_ic > 0 THEN 1.0 WHEN rank_ic IS NOT NULL THEN 0.0 END), 4) AS positive_share FROM folds GROUP BY factor""")
def walkforward_summary(spark, d):
    return E.fold_summary(_folds(spark, d)).withColumns({c: F.col(c) + F.lit(0.0) for c in ("ic_mean", "rank_ic_mean", "sharpe_mean")})


_BENCH = f"""{ROWS.replace('rows AS (SELECT factor', 'every AS (SELECT factor')},
spans AS (SELECT * FROM (VALUES ('IS', DATE '1996-01-01', DATE '1999-12-31'), ('OOS', DATE '2000-01-01', DATE '2001-12-31')) t(w, a, b)),
inside AS (SELECT e.*, w FROM every e JOIN spans ON trade_date BETWEEN a AND b),
ends AS (SELECT w, max(trade_date) AS last, min(trade_date) AS first FROM inside GROUP BY w),
rows AS (SELECT factor || '@' || w AS factor, trade_date, ts_code, score, fwd FROM inside JOIN ends USING (w) WHERE trade_date < last OR first = last),
{IC}, {LEGS}, costs AS (SELECT ls.*, bps FROM ls, (VALUES (0.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE)) c(bps)), {_net('factor, bps', 'bps', 'costs')},
{ICS},
bench AS (SELECT split_part(m.factor, '@', 1) AS factor, split_part(m.factor, '@', 2) AS "window", bps, days, sharpe, annual, max_drawdown, turnover, ic, icir, rank_ic FROM metrics m LEFT JOIN ics ON m.factor = ics.factor)"""


def bench(spark, d) -> DataFrame:
    out = _plain(E.bench(seed_rows(spark, d), WINDOWS, COSTS))
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in ("ic", "icir", "rank_ic")})


@query("bench_table", f"{_BENCH} SELECT * FROM bench")
def bench_table(spark, d):
    return bench(spark, d)


@query("sweep_topk", f"{_BENCH} SELECT factor, ic, sharpe FROM bench WHERE \"window\" = 'IS' AND bps = 5 ORDER BY ic DESC NULLS LAST, factor LIMIT 2")
def sweep_topk(spark, d):
    return E.top_k(bench(spark, d).where("bps = 5"), "ic", 2).select("factor", "ic", "sharpe")


@query("rebalance_dates", """WITH s AS (SELECT min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem), months AS (SELECT CAST(unnest(range(CAST(date_trunc('month', first) AS DATE), CAST(last + to_days(1) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS m, first, last FROM s),
days AS (SELECT CAST(m + to_days(CAST((5 - dayofweek(m) + 7) % 7 + 7 AS INTEGER)) AS DATE) AS rebalance_date, first, last FROM months WHERE month(m) IN (6, 12)) SELECT rebalance_date FROM days WHERE rebalance_date BETWEEN first AND last""")
def rebalance_dates(spark, d):
    """Those within the dates of the items."""
    first, last = P.table(spark, d, "lineitem").agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    return E.rebalance_dates(spark, str(first)[:10], str(last)[:10])


@query("component_gaps", f"WITH {PANEL}, {CONSTITUENTS}, want AS (SELECT CAST(unnest(range(DATE '1994-01-01', DATE '2003-01-01', INTERVAL 1 MONTH)) AS DATE) AS as_of) SELECT as_of AS missing FROM want WHERE month(as_of) IN (6, 12) AND as_of NOT IN (SELECT as_of FROM cons)")
def component_gaps(spark, d):
    want = spark.range(1).select(F.explode(F.expr("sequence(date'1994-01-01', date'2002-12-01', interval 1 month)")).alias("asof")).where(F.month("asof").isin(6, 12))
    return want.join(members(P.brand_panel(spark, d)).select("asof"), "asof", "left_anti").select(F.col("asof").alias("missing"))


# Series of long-short returns, one a seed.
_RETURNS = f"{ROWS}, {LEGS}, series AS (SELECT factor AS series_id, trade_date AS d, ls AS r FROM ls)"


def returns(spark, d) -> DataFrame:
    return E.long_short(seed_rows(spark, d)).select(F.col("factor").alias("series_id"), F.col("trade_date").alias("d"), F.col("ls").alias("r"))


@query("sharpe", f"{_RETURNS} SELECT series_id, CASE WHEN count(r) >= 20 THEN round(avg(r) * sqrt(252) / nullif(stddev_pop(r), 0), 6) END AS sharpe FROM series GROUP BY series_id")
def sharpe(spark, d):
    return S.sharpe(returns(spark, d)).withColumn("sharpe", F.round("sharpe", 6))


@query("equity_curve", f"{_RETURNS} SELECT series_id, d, round(product(1 + r) OVER (PARTITION BY series_id ORDER BY d), 6) AS nav FROM series")
def equity_curve(spark, d):
    return S.equity_curve(returns(spark, d)).select("series_id", "d", "nav")


@query("max_drawdown", f"""{_RETURNS}, nav AS (SELECT *, product(1 + r) OVER (PARTITION BY series_id ORDER BY d) AS nav FROM series),
peak AS (SELECT *, greatest(1.0, max(nav) OVER (PARTITION BY series_id ORDER BY d)) AS peak FROM nav) SELECT series_id, round(least(0.0, min(nav / peak - 1)), 6) AS max_drawdown FROM peak GROUP BY series_id""")
def max_drawdown(spark, d):
    return S.max_drawdown(returns(spark, d)).withColumn("max_drawdown", F.round("max_drawdown", 6))


@query("ic_tstat", f"{ROWS}, {IC} SELECT factor, round(avg(ic) / nullif(stddev_pop(ic), 0) * sqrt(count(ic)), 6) AS t FROM ic GROUP BY factor")
def ic_tstat(spark, d):
    ratio = F.avg("ic") / F.nullif(F.stddev_pop("ic"), F.lit(0.0))
    return E.daily_ic(seed_rows(spark, d)).groupBy("factor").agg(F.round(S.ic_t_stat(ratio, F.count("ic")), 6).alias("t"))


@query("return_moments", f"""{_RETURNS}, m AS (SELECT series_id, count(r) AS n, avg(r) AS m FROM series GROUP BY series_id)
SELECT series_id, any_value(n) AS n, round(any_value(m), 6) + 0.0 AS mean, round(avg((r - m) ** 2), 6) AS variance, round(avg((r - m) ** 3) / avg((r - m) ** 2) ** 1.5, 4) + 0.0 AS skew,
  round(avg((r - m) ** 4) / avg((r - m) ** 2) ** 2, 4) AS kurtosis FROM series JOIN m USING (series_id) GROUP BY series_id""")
def return_moments(spark, d):
    out = S.return_moments(returns(spark, d))
    return out.select("series_id", "n", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), F.round("variance", 6).alias("variance"), (F.round("skew", 4) + F.lit(0.0)).alias("skew"), F.round("kurtosis", 4).alias("kurtosis"))


def _horner(cs: list[float], x: str) -> str:
    return reduce(lambda acc, c: f"({acc} * {x} + {c!r}::DOUBLE)", cs[1:], f"{cs[0]!r}::DOUBLE")


_FAR = reduce(lambda acc, k: f"(a + {k} / {acc})", (4, 3, 2, 1), "(a + 0.65)")


#: CTE dsr (series_id, dsr) over series; {trials} is the factor of chance.
DSR_SQL = f"""dsr_n AS (SELECT series_id, count(r) AS n, avg(r) AS m FROM series GROUP BY series_id),
dsr_q AS (SELECT series_id, any_value(n) AS n, any_value(m) AS m, avg((r - m) ** 2) AS v, avg((r - m) ** 3) AS m3, avg((r - m) ** 4) AS m4 FROM series JOIN dsr_n USING (series_id) GROUP BY series_id),
dsr_s AS (SELECT series_id, n, m / sqrt(v) AS ratio, 1 - m3 / v ** 1.5 * m / sqrt(v) + (m4 / v ** 2 - 1) / 4 * (m / sqrt(v)) ** 2 AS spread FROM dsr_q WHERE n >= 20 AND v > 1e-12),
dsr_z AS (SELECT series_id, ratio * sqrt((n - 1) / spread) - {{trials!r}}::DOUBLE AS x FROM dsr_s WHERE spread > 0),
dsr_t AS (SELECT series_id, x, least(abs(x), 37.0) AS a FROM dsr_z),
dsr_u AS (SELECT series_id, x, exp(-a * a / 2) * CASE WHEN a < 7.07106781186547 THEN {_horner(S.TAIL_TOP, 'a')} / {_horner(S.TAIL_BOTTOM, 'a')} ELSE 1 / ({_FAR} * 2.506628274631) END AS tail FROM dsr_t),
dsr AS (SELECT series_id, CASE WHEN x > 0 THEN 1 - tail ELSE tail END AS dsr FROM dsr_n LEFT JOIN dsr_u USING (series_id))"""


@query("deflated_sharpe", f"""{_RETURNS}, {DSR_SQL.format(trials=S.chance_factor(145))} SELECT series_id, round(dsr, 8) AS dsr FROM dsr""")
def deflated_sharpe(spark, d):
    return S.deflated_sharpe(returns(spark, d), 145).withColumn("dsr", F.round("dsr", 8))


@query("finite_filter", "SELECT event_id, value FROM events WHERE isfinite(value) AND value < 100")
def finite_filter(spark, d):
    e = P.table(spark, d, "events")
    raw = F.when(F.col("value") >= 100, F.lit("Infinity")).otherwise(F.col("value").cast("string"))
    return e.select("event_id", S.finite(raw).alias("value")).where("value IS NOT NULL")


_CELLS = f"{_RETURNS}, n AS (SELECT count(DISTINCT series_id) AS n FROM series), dates AS (SELECT d FROM series GROUP BY d HAVING count(DISTINCT series_id) >= (SELECT greatest(2, CAST(floor(0.6 * n) AS INTEGER)) FROM n)), grid AS (SELECT m.series_id, dates.d, coalesce(r, 0) AS r FROM dates CROSS JOIN (SELECT DISTINCT series_id FROM series) m LEFT JOIN series s ON s.series_id = m.series_id AND s.d = dates.d)"
_PAST = "OVER (PARTITION BY series_id ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_WEIGHTS = f"{_CELLS}, inv AS (SELECT *, CASE WHEN count(r) {_PAST} >= 5 AND stddev_pop(r) {_PAST} > 1e-12 THEN 1 / stddev_pop(r) {_PAST} END AS inv FROM grid), weights AS (SELECT series_id, d, r, coalesce(inv / nullif(sum(inv) OVER (PARTITION BY d), 0), 0) AS w FROM inv)"
_CHURN = f"{_WEIGHTS}, steps AS (SELECT *, abs(w - lag(w) OVER (PARTITION BY series_id ORDER BY d)) AS step FROM weights), churn AS (SELECT d, sum(step) / 2 AS turnover, sum(w * r) AS gross, sum(w) AS held FROM steps GROUP BY d), combo AS (SELECT d, gross, turnover, gross - CASE WHEN turnover IS NOT NULL AND held > 0 THEN 5.0 / 10000 * turnover * 2 ELSE 0 END AS net FROM churn WHERE (SELECT count(*) FROM churn) >= 30)"


@query("combo_align", f"{_CELLS} SELECT series_id, d, round(r, 6) + 0.0 AS r FROM grid")
def combo_align(spark, d):
    return _rounded(S.covered_grid(returns(spark, d)), "r")


@query("inv_vol_weights", f"{_WEIGHTS} SELECT series_id, d, round(w, 6) AS w FROM weights")
def inv_vol_weights(spark, d):
    return S.inverse_vol_weights(S.covered_grid(returns(spark, d))).select("series_id", "d", F.round("w", 6).alias("w"))


@query("weight_turnover", f"{_CHURN} SELECT d, round(turnover, 6) AS turnover FROM churn")
def weight_turnover(spark, d):
    return S.weight_turnover(S.inverse_vol_weights(S.covered_grid(returns(spark, d)))).select("d", F.round("turnover", 6).alias("turnover"))


@query("combine_daily", f"{_CHURN} SELECT d, round(gross, 6) + 0.0 AS gross, round(turnover, 6) AS turnover, round(net, 6) + 0.0 AS net FROM combo")
def combine_daily(spark, d):
    return _rounded(S.combined(returns(spark, d)), "gross", "net").withColumn("turnover", F.round("turnover", 6))


@query("combo_vs_best", f"""{_CHURN}, ratios AS (SELECT 'combination' AS series_id, avg(net) * sqrt(252) / nullif(stddev_pop(net), 0) AS sharpe FROM combo
UNION ALL SELECT series_id, avg(r) * sqrt(252) / nullif(stddev_pop(r), 0) FROM grid WHERE d IN (SELECT d FROM combo) GROUP BY series_id)
SELECT round(max(sharpe) FILTER (series_id = 'combination'), 6) AS combo_sharpe, round(max(sharpe) FILTER (series_id <> 'combination'), 6) AS best_sharpe,
  max(sharpe) FILTER (series_id = 'combination') > max(sharpe) FILTER (series_id <> 'combination') AS beats_best FROM ratios""")
def combo_vs_best(spark, d):
    return S.combination_vs_best(returns(spark, d)).withColumns({c: F.round(c, 6) for c in ("combo_sharpe", "best_sharpe")})


@query("pairwise_corr", f"{_RETURNS} SELECT a.series_id AS a, b.series_id AS b, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0), 6) + 0.0 END AS corr FROM series a JOIN series b ON a.d = b.d AND a.series_id < b.series_id GROUP BY 1, 2")
def pairwise_corr(spark, d):
    return _rounded(S.pairwise(returns(spark, d)), "corr")


@query("common_dates", f"{_RETURNS} SELECT d FROM series WHERE series_id = 'mom_close_20' INTERSECT SELECT d FROM series WHERE series_id = 'rev_close_5'")
def common_dates(spark, d):
    r = returns(spark, d)
    return r.where("series_id = 'mom_close_20'").select("d").intersect(r.where("series_id = 'rev_close_5'").select("d"))


# The seeds' series, and on the dates of one of them a flat series and one that alternates, whose lags don't determine a fit.
_HEADS = f"""{_RETURNS.replace('series AS (SELECT factor', 'seeds AS (SELECT factor')}, series AS (SELECT * FROM seeds UNION ALL SELECT 'flat', d, 0.01::DOUBLE FROM seeds WHERE series_id = 'rev_close_5'
  UNION ALL SELECT 'zigzag', d, CASE WHEN row_number() OVER (ORDER BY d) % 2 = 0 THEN 0.02 ELSE -0.02 END::DOUBLE FROM seeds WHERE series_id = 'rev_close_5')"""
# The fit of the smallest norm is the limit of the ridge's; of two lags in one line it is that of the pseudo-inverse, X' (X X')^+ y, written out for each rank.
_OLS = f"""{_HEADS}, l AS (SELECT series_id, r AS y, lag(r, 1) OVER (PARTITION BY series_id ORDER BY d) AS x1, lag(r, 2) OVER (PARTITION BY series_id ORDER BY d) AS x2 FROM series),
m AS (SELECT series_id, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v11, var_pop(x2) AS v22, covar_pop(x1, x2) AS v12, covar_pop(x1, y) AS v1y, covar_pop(x2, y) AS v2y FROM l WHERE x2 IS NOT NULL GROUP BY series_id HAVING count(*) >= 4),
k AS (SELECT *, CASE WHEN v11 + v22 < 1e-20 THEN 0 WHEN v11 * v22 - v12 * v12 < 1e-11 * v11 * v22 THEN 1 ELSE 2 END AS kind FROM m),
u AS (SELECT *, v11 / sqrt(v11 * v11 + v12 * v12) AS u1, v12 / sqrt(v11 * v11 + v12 * v12) AS u2 FROM k WHERE kind = 1),
g AS (SELECT *, (v1y * u1 + v2y * u2) / (v11 + v22) AS g, u1 * m2 - u2 * m1 AS t FROM u),
b AS (SELECT series_id, n, my, m1, m2, (v1y * v22 - v2y * v12) / (v11 * v22 - v12 * v12) AS b1, (v2y * v11 - v1y * v12) / (v11 * v22 - v12 * v12) AS b2 FROM k WHERE kind = 2
  UNION ALL SELECT series_id, n, my, m1, m2, my * m1 / (1 + m1 * m1 + m2 * m2), my * m2 / (1 + m1 * m1 + m2 * m2) FROM k WHERE kind = 0
  UNION ALL SELECT series_id, n, my, m1, m2, g * u1 - u2 * t * (my - g * (u1 * m1 + u2 * m2)) / (1 + t * t), g * u2 + u1 * t * (my - g * (u1 * m1 + u2 * m2)) / (1 + t * t) FROM g),
h AS (SELECT series_id, n, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM b)"""


def head_series(spark, d) -> DataFrame:
    seeds = returns(spark, d)
    days = seeds.where("series_id = 'rev_close_5'").select("d", F.row_number().over(E.Window.partitionBy("series_id").orderBy("d")).alias("k"))
    flat = days.select(F.lit("flat").alias("series_id"), "d", F.lit(0.01).alias("r"))
    return seeds.unionByName(flat).unionByName(days.select(F.lit("zigzag").alias("series_id"), "d", F.when(F.expr("k % 2 = 0"), 0.02).otherwise(-0.02).alias("r")))


@query("ols_head", f"{_OLS} SELECT series_id, n, round(b0, 6) + 0.0 AS b0, round(b1, 6) + 0.0 AS b1, round(b2, 6) + 0.0 AS b2 FROM h")
def ols_head(spark, d):
    return _rounded(S.ols_head(head_series(spark, d)), "b0", "b1", "b2")


_CURVE = f"""{_OLS}, lagged_days AS (SELECT series_id, d, r AS y, lag(r, 1) OVER (PARTITION BY series_id ORDER BY d) AS x1, lag(r, 2) OVER (PARTITION BY series_id ORDER BY d) AS x2 FROM series),
fitted AS (SELECT series_id, d, b0 + b1 * x1 + b2 * x2 AS pred, (b0 + b1 * x1 + b2 * x2) * y AS pnl FROM lagged_days JOIN h USING (series_id) WHERE x2 IS NOT NULL),
curve AS (SELECT *, product(1 + pnl) OVER (PARTITION BY series_id ORDER BY d) AS nav FROM fitted)"""


@query("ols_curve", f"{_CURVE} SELECT series_id, d, round(pred, 6) + 0.0 AS pred, round(pnl, 8) + 0.0 AS pnl, round(nav, 6) AS nav FROM curve")
def ols_curve(spark, d):
    out = S.ols_curve(head_series(spark, d))
    return out.select("series_id", "d", (F.round("pred", 6) + F.lit(0.0)).alias("pred"), (F.round("pnl", 8) + F.lit(0.0)).alias("pnl"), F.round("nav", 6).alias("nav"))


@query("ols_portfolio", f"{_CURVE} SELECT series_id, CASE WHEN count(*) >= 2 THEN round(arg_max(nav, d) / nullif(arg_min(nav, d), 0) - 1, 6) + 0.0 END AS portfolio_return FROM curve GROUP BY series_id")
def ols_portfolio(spark, d):
    return _rounded(S.portfolio_return(S.head(head_series(spark, d))), "portfolio_return")


@query("eval_net_metrics", f"{ROWS}, {LEGS}, {_net('factor', '12.0')} SELECT factor, days, sharpe, annual, max_drawdown, turnover, turnover IS NULL AS no_turnover FROM metrics")
def eval_net_metrics(spark, d):
    return _plain(E.net_metrics(E.long_short(seed_rows(spark, d)), ["factor"], F.lit(12.0))).withColumn("no_turnover", F.col("turnover").isNull())


_GRADE = """50 + greatest(-20.0, least(20.0, ic * 200)) + greatest(-15.0, least(15.0, sharpe * 5)) - greatest(0.0, least(15.0, abs(mdd) * 20)) - greatest(0.0, least(20.0, pbo * 25))"""


@query("selection_score_folds", f"""{_FOLDS}, w AS (SELECT factor, count(*) AS n, avg(sharpe) AS oos FROM folds WHERE fold >= 2000 GROUP BY factor), i AS (SELECT factor, avg(sharpe) AS s, avg(annual) AS a, avg(ic) AS ic, min(max_drawdown) AS dd, avg(turnover) AS t FROM folds WHERE fold < 2000 GROUP BY factor)
SELECT factor, round(0.35 * a + 0.35 * CASE WHEN n >= 2 THEN (s + oos) / 2 ELSE s END + 0.15 * ic - 0.08 * abs(dd) - 0.04 * t - 0.03 * 0.1, 5) + 0.0 AS score FROM i LEFT JOIN w USING (factor)""")
def selection_score_folds(spark, d):
    """The score of each seed, whose years from 2000 on are its walk-forward windows."""
    late = F.col("fold") >= 2000
    early = lambda f, c: f(F.when(~late, F.col(c)))
    by = _folds(spark, d).groupBy("factor").agg(early(F.avg, "sharpe").alias("ratio"), early(F.avg, "annual").alias("annual"), early(F.avg, "ic").alias("ic"), early(F.min, "max_drawdown").alias("drawdown"), early(F.avg, "turnover").alias("turnover"), F.count(F.when(late, 1)).alias("windows"), F.avg(F.when(late, F.col("sharpe"))).alias("oos_ratio"), F.count(F.when(~late, 1)).alias("n"))
    columns = {c: F.col(c) for c in ("annual", "ratio", "ic", "drawdown", "turnover", "windows", "oos_ratio")}
    score = S.named_score("selection_score", drag=F.lit(0.1), **columns)["score"]
    return by.where("n > 0").select("factor", (F.round(score, 5) + F.lit(0.0)).alias("score"))


@query("library_grade", f"""WITH f AS (SELECT p_partkey AS id, (p_size - 25) / 250.0::DOUBLE AS ic, (p_partkey % 9 - 4)::DOUBLE AS sharpe, (p_size % 10) / 10.0::DOUBLE AS mdd, (p_partkey % 5) / 5.0::DOUBLE AS pbo FROM part),
s AS (SELECT id, round(greatest(0.0, least(100.0, {_GRADE})), 1) AS score FROM f) SELECT id, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade FROM s""")
def library_grade(spark, d):
    p = P.table(spark, d, "part")
    as_double = lambda x: F.expr(x).cast("double")
    score = S.library_score(as_double("p_size - 25") / 250, as_double("p_partkey % 9 - 4"), as_double("p_size % 10") / 10, as_double("p_partkey % 5") / 5)
    return p.select(F.col("p_partkey").alias("id"), score.alias("score")).withColumn("grade", S.grade(F.col("score")))


@query("selection_score", "SELECT p_partkey AS id, round(0.35 * p_size + 0.35 * (p_partkey % 7) + 0.15 * (p_partkey % 3) - 0.08 * abs(p_size - 25) - 0.04 * (p_partkey % 5) - 0.03 * (p_partkey % 11), 6)::DOUBLE AS score FROM part")
def selection_score(spark, d):
    v = lambda x: F.expr(x).cast("double")
    return P.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(S.selection_score(v("p_size"), v("p_partkey % 7"), v("p_partkey % 3"), v("p_size - 25"), v("p_partkey % 5"), v("p_partkey % 11")), 6).alias("score"))

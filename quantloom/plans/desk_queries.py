"""Queries of a research desk: job logs, chains of factors, heads that are fitted anew, sweeps with bad candidates, SQLite catalogs, cached results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import cache, jobs
from quantloom.operators import chains as H
from quantloom.operators import evaluation as E
from quantloom.operators import records as C
from quantloom.operators import series as S
from quantloom.operators.boosting import boosted_head as boosted
from quantloom.plans.evaluation_queries import IC
from quantloom.plans.panel_queries import FORWARD, SWEEP, SWEEP_SQL, ranked
from quantloom.plans.record_queries import _CATALOG, _POOL_SERIES, POOL, _catalog, pool_series
from quantloom.plans.registry import PANEL, query
from quantloom.session import saved, scratch
from quantloom.sources import panel as P
from quantloom.sources import sqlite
from quantloom.sources.panel import table

# A job log of the events: each user is a desk; an event that needs a job means the last one that was asked for, or now and then one that never was.
_OPS = """e AS (SELECT user_id AS desk, event_id AS seq, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'finish' WHEN 'purchase' THEN 'cancel' WHEN 'error' THEN 'exit' ELSE CASE event_id % 3 WHEN 0 THEN 'submit' WHEN 1 THEN 'run' ELSE 'delete' END END AS op FROM events),
o AS (SELECT *, CASE WHEN op IN ('start', 'submit', 'run') THEN seq END AS made FROM e),
l AS MATERIALIZED (SELECT desk, seq, op, row_number() OVER (PARTITION BY desk ORDER BY seq) AS n, CASE WHEN seq % 7 = 0 AND made IS NULL THEN 'j?' ELSE 'j' || coalesce(last_value(made IGNORE NULLS) OVER (PARTITION BY desk ORDER BY seq ROWS UNBOUNDED PRECEDING), -1) END AS job,
  'k' || seq % 3 AS kind, CASE WHEN seq % 2 = 0 THEN 'd' || seq % 4 END AS key, CASE WHEN seq % 4 = 0 THEN 'error' ELSE 'done' END AS status, CASE WHEN seq % 4 = 0 THEN 'failed at ' || seq END AS error FROM o)"""
_ROW = "STRUCT(id VARCHAR, kind VARCHAR, key VARCHAR, st VARCHAR, err VARCHAR, made BIGINT, changed BIGINT)"
_ACTIVE = "list_filter({}, lambda x: x.st IN ('running', 'queued'))"
#: The table of each desk's jobs after each op, by recursion over its log.
_JOBS = f"""{_OPS},
step AS (SELECT DISTINCT desk, 0::BIGINT AS n, []::{_ROW}[] AS tab, NULL::BIGINT AS seq, NULL::VARCHAR AS op, NULL::VARCHAR AS job, true AS ok, NULL::VARCHAR AS reason, NULL::VARCHAR AS other_id FROM l
UNION ALL SELECT desk, n, CASE
    WHEN op IN ('start', 'submit', 'run') AND ok THEN list_append(tab, {{'id': job, 'kind': kind, 'key': key, 'st': CASE op WHEN 'submit' THEN 'queued' ELSE 'running' END, 'err': NULL, 'made': seq, 'changed': seq}}::{_ROW})
    WHEN op = 'finish' THEN list_transform(tab, lambda x: CASE WHEN x.id = job THEN {{'id': x.id, 'kind': x.kind, 'key': x.key, 'st': status, 'err': error, 'made': x.made, 'changed': seq}}::{_ROW} ELSE x END)
    WHEN op = 'exit' AND ok THEN list_transform(tab, lambda x: CASE WHEN x.id = job THEN {{'id': x.id, 'kind': x.kind, 'key': x.key, 'st': 'error', 'err': 'child_exited', 'made': x.made, 'changed': seq}}::{_ROW} ELSE x END)
    WHEN op = 'cancel' AND ok THEN list_transform(tab, lambda x: CASE WHEN x.id = job THEN {{'id': x.id, 'kind': x.kind, 'key': x.key, 'st': 'cancelled', 'err': x.err, 'made': x.made, 'changed': seq}}::{_ROW} ELSE x END)
    WHEN op = 'delete' THEN list_filter(tab, lambda x: x.id <> job) ELSE tab END AS tab, seq, op, job, ok,
  CASE WHEN ok THEN NULL WHEN op = 'start' THEN CASE WHEN len(same) > 0 THEN 'duplicate_pending' ELSE 'max_jobs_reached' END WHEN op = 'exit' THEN 'not_running'
    WHEN len(mine) = 0 THEN 'unknown job ' || job ELSE 'job not cancellable: ' || mine[1].st END AS reason, CASE WHEN op = 'start' AND NOT ok THEN same[-1].id END AS other_id
FROM (SELECT *, CASE op WHEN 'start' THEN len(same) = 0 AND len(active) < 2 WHEN 'exit' THEN len(list_filter(mine, lambda x: x.st = 'running')) > 0 WHEN 'cancel' THEN len(list_filter(mine, lambda x: x.st IN ('running', 'queued'))) > 0 ELSE true END AS ok
  FROM (SELECT l.*, s.tab, {_ACTIVE.format('s.tab')} AS active, list_filter({_ACTIVE.format('s.tab')}, lambda x: x.kind = l.kind AND (l.key IS NULL OR x.key = l.key)) AS same, list_filter(s.tab, lambda x: x.id = l.job) AS mine
    FROM step s JOIN l ON l.desk = s.desk AND l.n = s.n + 1)))"""


def job_ops(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "finish").when(F.col("event_type") == "purchase", "cancel").when(F.col("event_type") == "error", "exit")
    op = F.coalesce(op, F.when(F.expr("event_id % 3 = 0"), "submit").when(F.expr("event_id % 3 = 1"), "run").otherwise("delete"))
    made = F.when(F.col("op").isin("start", "submit", "run"), F.col("seq"))
    last = F.last(made, ignorenulls=True).over(C.Window.partitionBy("desk").orderBy("seq").rowsBetween(C.Window.unboundedPreceding, 0))
    text = lambda c: c.cast("string")
    job = F.when(F.expr("seq % 7 = 0") & made.isNull(), "j?").otherwise(F.concat(F.lit("j"), text(F.coalesce(last, F.lit(-1)))))
    failed = F.expr("seq % 4 = 0")
    rows = e.select(F.col("user_id").cast("string").alias("desk"), F.col("event_id").alias("seq"), op.alias("op"))
    return rows.select("desk", "seq", "op", job.alias("job_id"), F.concat(F.lit("k"), text(F.expr("seq % 3"))).alias("kind"), F.when(F.expr("seq % 2 = 0"), F.concat(F.lit("d"), text(F.expr("seq % 4")))).alias("dedup_key"), F.when(failed, "error").otherwise("done").alias("status"), F.when(failed, F.concat(F.lit("failed at "), text(F.col("seq")))).alias("error"))


@query("job_lifecycle", f"""WITH RECURSIVE {_JOBS} SELECT CAST(desk AS VARCHAR) AS desk, seq, op, job AS job_id, ok, reason, other_id, CAST(len({_ACTIVE.format('tab')}) AS INTEGER) AS n_active, list_filter(tab, lambda x: x.id = job)[1].st AS status FROM step WHERE n > 0""")
def job_lifecycle(spark, d):
    """What became of every op: started, refused and why, and the state of its job after it."""
    return jobs.decisions(job_ops(spark, d)).select("desk", "seq", "op", "job_id", "ok", "reason", "other_id", "n_active", "status")


@query("job_table", f"""WITH RECURSIVE {_JOBS}, ends AS (SELECT desk, max(n) AS n FROM step GROUP BY desk), rows AS (SELECT s.desk, unnest(s.tab) AS j FROM step s JOIN ends USING (desk, n))
SELECT CAST(desk AS VARCHAR) AS desk, j.id AS job_id, j.kind AS kind, j.st AS status, j.err AS error, j.made AS created_seq, j.changed AS updated_seq FROM rows""")
def job_table(spark, d):
    """The jobs of every desk in the end."""
    return jobs.jobs(jobs.decisions(job_ops(spark, d)))


# The part pool as records in order of their number, some without a rank_ic.
_CHAIN = "STRUCT(k BIGINT, chain BIGINT, pos BIGINT, ric DOUBLE)"
_CHAINS = f"""{_POOL_SERIES},
rec AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p_partkey % {POOL}) AS k, p_partkey % {POOL} AS p, 'p' || p_partkey % {POOL} AS record_id, CASE WHEN p_partkey % {POOL} % 23 > 0 THEN (sum(p_size) % 41 - 20) / 1000.0::DOUBLE END AS ric FROM part GROUP BY p_partkey % {POOL}),
links AS (SELECT greatest(x.k, y.k) AS k, least(x.k, y.k) AS j, abs(corr) AS c FROM (SELECT a.series_id AS a, b.series_id AS b, covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0) AS corr FROM series a JOIN series b ON a.d = b.d AND a.series_id < b.series_id GROUP BY 1, 2 HAVING count(*) >= 10) p
  JOIN rec x ON x.record_id = p.a JOIN rec y ON y.record_id = p.b WHERE abs(corr) >= 0.7),
near AS MATERIALIZED (SELECT k, list({{'j': j, 'c': c}}) AS near FROM links GROUP BY k),
step AS (SELECT 0::BIGINT AS k, []::{_CHAIN}[] AS m, 0::BIGINT AS n_chains, NULL::VARCHAR AS action, NULL::BIGINT AS chain, NULL::BIGINT AS position, NULL::BIGINT AS best_member_position
UNION ALL SELECT k, CASE WHEN action = 'reject_not_beating_chain' THEN m ELSE list_append(m, {{'k': k, 'chain': chain, 'pos': position, 'ric': ric}}::{_CHAIN}) END, n_chains + CASE WHEN action = 'new_chain' THEN 1 ELSE 0 END, action, chain, position, best.pos
FROM (SELECT *, CASE WHEN best IS NULL THEN n_chains ELSE best.chain END AS chain, CASE action WHEN 'new_chain' THEN 0 WHEN 'extend' THEN CAST(len(own) AS BIGINT) END AS position
  FROM (SELECT *, CASE WHEN best IS NULL THEN 'new_chain' WHEN ric > coalesce(list_max(list_transform(own, lambda x: CASE WHEN x.ric <> 0 THEN x.ric END)), '-inf'::DOUBLE) THEN 'extend' ELSE 'reject_not_beating_chain' END AS action
    FROM (SELECT *, list_filter(m, lambda x: x.chain = best.chain) AS own
      FROM (SELECT rec.k, rec.ric, s.m, s.n_chains, list_sort(list_transform(list_filter(s.m, lambda x: len(list_filter(near, lambda y: y.j = x.k)) > 0), lambda x: {{'s': -(list_filter(near, lambda y: y.j = x.k)[1].c), 'chain': x.chain, 'pos': x.pos}}))[1] AS best
        FROM step s JOIN rec ON rec.k = s.k + 1 LEFT JOIN near ON near.k = rec.k)))))"""


def _chains(spark, d) -> DataFrame:
    k = F.expr(f"p_partkey % {POOL}")
    sums = table(spark, d, "part").groupBy(k.alias("k")).agg(F.sum("p_size").alias("s"))
    records = sums.select(F.col("k").alias("seq"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("record_id"), F.when(F.expr("k % 23 > 0"), F.expr("(s % 41 - 20) / 1000D")).alias("rank_ic"))
    return H.chain_updates(records, saved(pool_series(spark, d), "series"))


@query("chain_decision", f"WITH RECURSIVE {_CHAINS} SELECT p AS seq, record_id, action, chain, position, best_member_position, step.n_chains FROM step JOIN rec USING (k)")
def chain_decision(spark, d):
    """Which chain every factor of the part pool extends, or begins, or fails to extend."""
    return _chains(spark, d).select("seq", "record_id", "action", "chain", "position", "best_member_position", "n_chains")


@query("chain_table", f"""WITH RECURSIVE {_CHAINS}, held AS (SELECT chain, position, record_id, ric FROM step JOIN rec USING (k) WHERE position IS NOT NULL)
SELECT chain, count(*) AS length, arg_min(record_id, position) AS head, arg_max(record_id, position) AS tail, max(coalesce(ric, 0)) AS best_rank_ic FROM held GROUP BY chain""")
def chain_table(spark, d):
    return H.chains_of(_chains(spark, d))


def supplier_returns(spark, d) -> DataFrame:
    before = F.lag("close").over(C.Window.partitionBy("ts_code").orderBy("trade_date"))
    return P.supplier_panel(spark, d).select(F.col("ts_code").alias("series_id"), F.col("trade_date").alias("d"), (F.col("close") / before - 1).alias("r")).where("r IS NOT NULL")


@query("boosted_head")
def boosted_head(spark, d):
    """The boosted head of every supplier's monthly returns, fitted anew each month."""
    out = boosted(supplier_returns(spark, d))
    return out.select("series_id", "d", *(F.round(c, 6).alias(c) for c in ("pred", "pnl", "nav")))


@query("boosted_portfolio")
def boosted_portfolio(spark, d):
    return S.portfolio_return(S.head(supplier_returns(spark, d), "gbm")).withColumn("portfolio_return", F.round("portfolio_return", 6))


BAD = [("mom", "turnover", 5), ("waves", "close", 5), ("rev", "close", 0)]


@query("sweep_isolated", f"""WITH {PANEL}, scores AS ({' UNION ALL '.join(f"SELECT '{k}' AS factor, * FROM ({ranked(v)})" for k, v in SWEEP_SQL.items())}), fwd AS ({FORWARD}),
rows AS (SELECT factor, s.trade_date, s.ts_code, score, fwd FROM scores s JOIN fwd USING (trade_date, ts_code) WHERE score IS NOT NULL AND fwd IS NOT NULL), {IC}
SELECT factor, true AS ok, NULL::VARCHAR AS error, count(ic) AS days, CASE WHEN count(ic) >= 20 THEN round(avg(ic), 6) + 0.0 END AS mean, CASE WHEN count(ic) >= 20 THEN round(avg(ic) / nullif(stddev_pop(ic), 0), 4) + 0.0 END AS ratio FROM ic GROUP BY factor
UNION ALL SELECT * FROM (VALUES ('mom_turnover_5', false, 'the panel has no field turnover', 0, NULL, NULL), ('waves_close_5', false, 'unknown template waves', 0, NULL, NULL), ('rev_close_0', false, 'not a window: 0', 0, NULL, NULL)) t""")
def sweep_isolated(spark, d):
    """A sweep with three candidates that can't be computed: these are rows with an error, the others are scored in one job."""
    out = E.sweep(P.brand_panel(spark, d), [*SWEEP[:2], *BAD, *SWEEP[2:]])
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in ("mean", "ratio")})


@query("sqlite_search", f"WITH {_CATALOG} SELECT id, name, style, updated_at FROM (SELECT id, name, style, CAST(updated_at AS VARCHAR) AS updated_at FROM cat) WHERE style = 'ECONOMY' AND name ILIKE '%RED%' ORDER BY updated_at DESC, id LIMIT 20")
def sqlite_search(spark, d):
    """The catalog search over SQLite files that hold the catalog; the style is told by SQLite."""
    folder = f"{scratch(spark)}/sqlite-{C.uuid4().hex}"
    cat = _catalog(spark, d)
    sqlite.write(cat.withColumns({c: F.col(c).cast("string") for c in ("created_at", "updated_at")}), folder, "factor_catalog", ["style"])
    return C.search(sqlite.read(spark, folder, "factor_catalog"), "RED", 20, style="ECONOMY").select("id", "name", "style", "updated_at")


@query("cached_result", f"WITH {PANEL} SELECT count(DISTINCT ts_code) AS n_assets, count(DISTINCT trade_date) AS n_days, true AS cached FROM p")
def cached_result(spark, d):
    """Panel statistics, asked for twice: the second time they are read."""
    root = f"{scratch(spark)}/results-{C.uuid4().hex}"
    inputs = [f"{d}/lineitem.parquet", f"{d}/part.parquet"]
    ask = lambda: cache.cached(spark, "panel_stats", {"panel": "brand"}, inputs, lambda: P.stats(P.brand_panel(spark, d)), root)
    ask()
    out, known = ask()
    return out.select("n_assets", "n_days", F.lit(known).alias("cached"))

"""Queries over record tables: catalog, trace, audit, jobs, campaign, wiki, gates and greedy selection.

Record tables are read from the given ones: parts as catalog entries, events as a trace, pages and
documents as wiki pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import expressions as X
from quantloom.operators import gates as G
from quantloom.operators import pool
from quantloom.operators import records as C
from quantloom.operators import series as S
from quantloom.operators import structure as T
from quantloom.plans.evaluation_queries import DSR_SQL
from quantloom.plans.panel_queries import _PART_TEXTS, FORM_COUNTS, part_texts
from quantloom.plans.registry import query
from quantloom.session import saved
from quantloom.sources import panel as P
from quantloom.sources.panel import table

#: Series of the part pool: monthly changes of the mean price of parts by key modulo this, so as many factors at every scale.
POOL = 320
_POOL_SERIES = f"""bars AS (SELECT 'p' || l_partkey % {POOL} AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close FROM lineitem GROUP BY 1, 2),
moves AS (SELECT series_id, d, close / lag(close) OVER (PARTITION BY series_id ORDER BY d) - 1 AS r FROM bars), series AS (SELECT * FROM moves WHERE r IS NOT NULL)"""
_POOL_FACTORS = f"""factors AS (SELECT 'p' || p_partkey % {POOL} AS name, (sum(p_size) % 41 - 20) / 1000.0::DOUBLE AS ic, CAST(sum(p_size * 7) % 53 AS DOUBLE) AS score, 'm' || p_partkey % {POOL} % 3 AS profile, p_partkey % {POOL} % 19 = 0 AS simulated, CASE WHEN p_partkey % {POOL} % 17 = 0 THEN 'culled' ELSE 'review' END AS status FROM part GROUP BY p_partkey % {POOL})"""


def pool_series(spark, d) -> DataFrame:
    bars = P.bars_of(table(spark, d, "lineitem"), F.concat(F.lit("p"), F.expr(f"l_partkey % {POOL}").cast("string")))
    before = F.lag("close").over(C.Window.partitionBy("ts_code").orderBy("trade_date"))
    return bars.select(F.col("ts_code").alias("series_id"), F.col("trade_date").alias("d"), (F.col("close") / before - 1).alias("r")).where("r IS NOT NULL")


def pool_factors(spark, d) -> DataFrame:
    by = table(spark, d, "part").groupBy(F.expr(f"p_partkey % {POOL}").alias("k")).agg(F.sum("p_size").alias("s"), F.sum(F.expr("p_size * 7")).alias("t"))
    return by.select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("name"), F.expr("(s % 41 - 20) / 1000D").alias("ic"), F.expr("CAST(t % 53 AS DOUBLE)").alias("score"), F.concat(F.lit("m"), F.expr("k % 3").cast("string")).alias("profile"), F.expr("k % 19 = 0").alias("simulated"), F.expr("CASE WHEN k % 17 = 0 THEN 'culled' ELSE 'review' END").alias("status"))


#: What an expression must differ from; forms of _PART_TEXTS with given fields and windows, so that only equal ones are more alike than the gate allows.
GATE_CORPUS = ["Rank(Delta(close, 7))", "-Rank(Corr(open, close, 12))", "If(Greater(high, low), Mean(high, 5), -Mean(low, 5))", "Foo(open, 3)", "not one ("]
_KNOWN = ", ".join(f"'{t}'" for t in [*GATE_CORPUS, "-Rank(Corr(close, open, 12))"])
TRIALS = 145
_DAY = "CAST(DATE '2024-01-01' + to_days(CAST({} AS INTEGER)) AS DATE)"
_CATALOG = f"cat AS (SELECT 'part' AS source, p_partkey % 500 AS source_ref, p_partkey AS id, p_name AS name, 'Rank(' || p_type || ')' AS formula, p_brand || '-cn' AS name_cn, p_type AS style, p_brand AS status, {_DAY.format('p_partkey % 300')} AS created_at, {_DAY.format('p_partkey % 300 + 1')} AS updated_at FROM part)"


def _catalog(spark, d) -> DataFrame:
    day = lambda x: F.date_add(F.lit("2024-01-01").cast("date"), F.expr(x).cast("int"))
    return table(spark, d, "part").select(F.lit("part").alias("source"), F.expr("p_partkey % 500").alias("source_ref"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("Rank("), F.col("p_type"), F.lit(")")).alias("formula"), F.concat(F.col("p_brand"), F.lit("-cn")).alias("name_cn"), F.col("p_type").alias("style"), F.col("p_brand").alias("status"), day("p_partkey % 300").alias("created_at"), day("p_partkey % 300 + 1").alias("updated_at"))


@query("catalog_search", f"WITH {_CATALOG} SELECT id, name, style, updated_at FROM cat WHERE style = 'ECONOMY' AND name ILIKE '%RED%' ORDER BY updated_at DESC, id LIMIT 20")
def catalog_search(spark, d):
    return C.search(_catalog(spark, d), "RED", 20, style="ECONOMY").select("id", "name", "style", "updated_at")


@query("catalog_search_all", f"WITH {_CATALOG} SELECT id, name, formula, name_cn FROM cat WHERE name ILIKE '%eco%' OR formula ILIKE '%eco%' OR name_cn ILIKE '%eco%' UNION ALL SELECT id, name, formula, name_cn FROM cat WHERE name ILIKE '%#1_-CN%' OR formula ILIKE '%#1_-CN%' OR name_cn ILIKE '%#1\\_-CN%' ESCAPE '\\'")
def catalog_search_all(spark, d):
    cat = _catalog(spark, d)
    return C.search(cat, "eco", 1 << 30).unionByName(C.search(cat, "#1_-CN", 1 << 30)).select("id", "name", "formula", "name_cn")


_LIBRARY = f"lib AS (SELECT 'library' AS source, s_suppkey AS id, s_name AS name, {_DAY.format('s_suppkey % 300')} AS updated_at FROM supplier)"


@query("catalog_search_fallback", f"""WITH {_CATALOG}, {_LIBRARY}, a AS (SELECT id, name, 'catalog' AS origin, updated_at FROM cat WHERE name ILIKE '%supplier%' ORDER BY updated_at DESC, id LIMIT 9),
b AS (SELECT id, name, 'library' AS origin, updated_at FROM lib WHERE name ILIKE '%supplier%' ORDER BY updated_at DESC, id LIMIT 9), c AS (SELECT id, name, 'catalog' AS origin, updated_at FROM cat WHERE name ILIKE '%red%' ORDER BY updated_at DESC, id LIMIT 9)
SELECT id, name, origin FROM a UNION ALL SELECT id, name, origin FROM b WHERE (SELECT count(*) FROM a) = 0 UNION ALL SELECT id, name, origin FROM c""")
def catalog_search_fallback(spark, d):
    """Two searches: one that the catalog knows nothing of, which the library answers, and one that it knows."""
    cat = _catalog(spark, d).select("source", "id", "name", "updated_at")
    lib = table(spark, d, "supplier").select(F.lit("library").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.date_add(F.lit("2024-01-01").cast("date"), F.expr("CAST(s_suppkey % 300 AS INT)")).alias("updated_at"))
    return C.search_or(cat, lib, "supplier", 9).unionByName(C.search_or(cat, lib, "red", 9)).select("id", "name", "origin")


# Three stores of entries; a rebuild upserts them over a catalog that has some of them.
_STORES = """stores AS (SELECT 'part' AS source, p_partkey AS source_ref, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer),
before AS (SELECT source, source_ref, source || source_ref AS id, 'old' AS name, 1 AS created_at FROM stores WHERE source_ref % 3 = 0),
again AS (SELECT source, source_ref, 'new-' || source || source_ref AS id, name, 2 AS created_at FROM stores)"""


@query("catalog_rebuild_union", f"WITH {_STORES} SELECT source, source_ref, coalesce(b.id, a.id) AS id, a.name, coalesce(b.created_at, a.created_at) AS created_at FROM again a LEFT JOIN before b USING (source, source_ref)")
def catalog_rebuild_union(spark, d):
    pick = lambda t, k, n: table(spark, d, t).select(F.lit(t).alias("source"), F.col(k).alias("source_ref"), F.col(n).alias("name"))
    stores = pick("part", "p_partkey", "p_name").unionByName(pick("supplier", "s_suppkey", "s_name")).unionByName(pick("customer", "c_custkey", "c_name"))
    key = F.concat("source", F.col("source_ref").cast("string"))
    before = stores.where("source_ref % 3 = 0").select("source", "source_ref", key.alias("id"), F.lit("old").alias("name"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    again = stores.select("source", "source_ref", F.concat(F.lit("new-"), key).alias("id"), "name", F.lit(2).alias("created_at"), F.lit(2).alias("updated_at"))
    return C.upserted(before, again).select("source", "source_ref", "id", "name", "created_at")


@query("jobs_degraded", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, count(*) >= 3 AND bool_and(event_type IN ('error', 'view')) AS degraded FROM r WHERE rn <= 3 GROUP BY user_id""")
def jobs_degraded(spark, d):
    last = C.F.row_number().over(C.Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    failed = F.col("event_type").isin("error", "view")
    return table(spark, d, "events").withColumn("rn", last).where("rn <= 3").groupBy("user_id").agg(((F.count("*") >= 3) & F.every(failed)).alias("degraded"))


# Errors whose keys are event types or beginnings of them, of any length from none.
_ERRORS = "CASE WHEN user_id % 7 = 0 THEN left(event_type, CAST(user_id // 7 % 5 AS INTEGER)) ELSE event_type END || CASE WHEN user_id % 2 = 0 THEN ': user ' || user_id ELSE '' END"


@query("error_prefix_match", f"""WITH e AS (SELECT DISTINCT {_ERRORS} AS e FROM events), m AS (SELECT e, lower(trim(split_part(e, ':', 1))) AS key FROM e), k AS (SELECT DISTINCT key FROM m)
SELECT m.e, m.key, k.key AS longer FROM m JOIN k ON starts_with(k.key, m.key)""")
def error_prefix_match(spark, d):
    kind = F.when(F.expr("user_id % 7 = 0"), F.expr("left(event_type, CAST(user_id div 7 % 5 AS INT))")).otherwise(F.col("event_type"))
    tail = F.when(F.expr("user_id % 2 = 0"), F.concat(F.lit(": user "), F.col("user_id").cast("string"))).otherwise("")
    members, kin = C.error_kin(table(spark, d, "events").select(F.concat(kind, tail).alias("e")))
    return members.join(kin, "key").select("e", "key", "longer")


@query("similar_errors", """WITH f AS (SELECT event_id, ts, event_type || ': at ' || user_id AS error FROM events WHERE event_type IN ('error', 'click') ORDER BY ts DESC, event_id DESC LIMIT 80)
SELECT event_id, error FROM f WHERE lower(trim(split_part(error, ':', 1))) = 'error'""")
def similar_errors(spark, d):
    failed = F.when(F.col("event_type").isin("error", "click"), F.concat("event_type", F.lit(": at "), F.col("user_id").cast("string")))
    return C.similar_errors(table(spark, d, "events").select("event_id", "ts", failed.alias("error")), "Error : of today").select("event_id", "error")


# Results of a campaign: none, of several states, with factors that have one id, another or none, with and without an error.
_RESULTS = """r AS (SELECT event_id, event_id % 11 > 0 AS found, CASE user_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_factors' WHEN 2 THEN '' WHEN 3 THEN 'partial' END AS status,
  [x for x in [CASE WHEN user_id % 3 > 0 THEN 'f' || event_id END, CASE WHEN event_id % 4 = 0 THEN 'g' || user_id END] if x IS NOT NULL] AS ids, user_id % 6 = 5 AS nameless,
  CASE WHEN event_type = 'error' THEN repeat(event_type || ' ' || event_id || ';', 60) WHEN event_type = 'view' THEN '  ' END AS error FROM events)"""


@query("classify_outcome", f"""WITH {_RESULTS}, n AS (SELECT *, len(ids) + CAST(nameless AS INTEGER) AS n_factors FROM r)
SELECT event_id, CASE WHEN NOT found THEN 'failed' WHEN coalesce(status, '') = 'no_factors' OR (coalesce(status, '') IN ('', 'ok') AND n_factors = 0) THEN 'no_factors' WHEN trim(coalesce(error, '')) <> '' THEN 'failed' WHEN len(ids) = 0 THEN 'no_factors' ELSE 'done' END AS state,
  CASE WHEN found AND NOT (coalesce(status, '') = 'no_factors' OR (coalesce(status, '') IN ('', 'ok') AND n_factors = 0)) AND trim(coalesce(error, '')) = '' THEN array_to_string(ids, ',') ELSE '' END AS catalog_ids,
  CASE WHEN NOT found THEN 'empty_result' WHEN coalesce(status, '') = 'no_factors' THEN NULL WHEN coalesce(status, '') IN ('', 'ok') AND n_factors = 0 THEN 'no_factors_from:' || coalesce(nullif(status, ''), 'unknown') WHEN trim(coalesce(error, '')) <> '' THEN left(error, 300) END AS error FROM n""")
def classify_outcome(spark, d):
    text = lambda c: c.cast("string")
    status = F.when(F.expr("user_id % 5 = 0"), "ok").when(F.expr("user_id % 5 = 1"), "no_factors").when(F.expr("user_id % 5 = 2"), "").when(F.expr("user_id % 5 = 3"), "partial")
    one = lambda a, b: F.struct(a.cast("string").alias("catalog_id"), b.cast("string").alias("id"))
    none = F.lit(None)
    factors = F.array_compact(F.array(F.when(F.expr("user_id % 3 > 0"), one(F.concat(F.lit("f"), text(F.col("event_id"))), F.lit("unused"))), F.when(F.expr("event_id % 4 = 0"), one(F.lit(""), F.concat(F.lit("g"), text(F.col("user_id"))))), F.when(F.expr("user_id % 6 = 5"), one(none, none))))
    error = F.when(F.col("event_type") == "error", F.repeat(F.concat("event_type", F.lit(" "), text(F.col("event_id")), F.lit(";")), F.lit(60))).when(F.col("event_type") == "view", "  ")
    out = table(spark, d, "events").select("event_id", C.outcome(F.expr("event_id % 11 > 0"), status, factors, error).alias("o"))
    return out.select("event_id", F.col("o.state").alias("state"), F.array_join("o.catalog_ids", ",").alias("catalog_ids"), F.col("o.error").alias("error"))


@query("broad_universe", "SELECT p_partkey AS id, p_partkey % 3 = 0 AS broad FROM part")
def broad_universe(spark, d):
    universe = F.when(F.expr("p_partkey % 6 = 0"), " CSI 300").when(F.expr("p_partkey % 3 = 0"), "all_a").otherwise("local_panel")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), G.claims_broad(universe).alias("broad"))


_INGEST = "f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'pool' ELSE 'library' END AS kind, p_size % 3 AS n_returns, p_size % 5 > 0 AS has_metrics, CASE WHEN p_size % 4 > 0 THEN p_size / 100.0::DOUBLE END AS ic FROM part)"


@query("ingest_accept", f"WITH {_INGEST} SELECT id, kind FROM f WHERE (kind = 'pool' AND n_returns > 0) OR (kind = 'library' AND has_metrics AND (ic IS NOT NULL OR n_returns > 0))")
def ingest_accept(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.expr("p_partkey % 2 = 0"), "pool").otherwise("library").alias("kind"), F.expr("p_size % 3").alias("n_returns"), F.expr("p_size % 5 > 0").alias("has_metrics"), F.expr("CASE WHEN p_size % 4 > 0 THEN p_size / 100D END").alias("ic"))
    return C.accepted(f).select("id", "kind")


@query("record_adapt", """SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size / 1000.0::DOUBLE END, CASE WHEN p_size % 3 = 1 THEN p_size / 500.0::DOUBLE END, 0.0) AS ic,
  array_to_string(list_sort(list_distinct(regexp_extract_all(lower('Rank($close) / ' || p_name || ' - $OPEN + close'), '\\b(open|high|low|close|volume|amount|vwap)\\b', 1))), ',') AS fields FROM part""")
def record_adapt(spark, d):
    text = F.lower(F.concat(F.lit("Rank($close) / "), F.col("p_name"), F.lit(" - $OPEN + close")))
    fields = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(open|high|low|close|volume|amount|vwap)\b"), 1)))
    ic = F.coalesce(F.expr("CASE WHEN p_size % 3 = 0 THEN p_size / 1000D END"), F.expr("CASE WHEN p_size % 3 = 1 THEN p_size / 500D END"), F.lit(0.0))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), ic.alias("ic"), F.array_join(fields, ",").alias("fields"))


@query("campaign_pending", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def campaign_pending(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return o.join(o.where("o_orderstatus = 'F'").select("id"), "id", "left_anti").select("id")


@query("campaign_stats", "SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey % 4) AS BIGINT) AS n_cataloged, CAST(sum(count(*)) OVER () AS BIGINT) AS total_known FROM orders GROUP BY o_orderstatus")
def campaign_stats(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum(F.expr("o_orderkey % 4")).alias("n_cataloged"))
    return o.crossJoin(F.broadcast(o.agg(F.sum("n").alias("total_known"))))


@query("review_queue", "SELECT e.event_id, p.p_name AS name, p.p_brand AS status FROM events e LEFT JOIN part p ON e.user_id = p.p_partkey WHERE e.event_type = 'signup'")
def review_queue(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("user_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("status"))
    return table(spark, d, "events").where("event_type = 'signup'").join(parts, "user_id", "left").select("event_id", "name", "status")


# A wiki whose pages link to their neighbours, some of them unknown.
_WIKI = "wiki AS (SELECT 'p-' || page_id AS slug, page_id, 'see [[p-' || (page_id + 1) || ']] and [[p-' || (page_id * 7 % 400) || ']] or [[Nowhere]]' AS text, url FROM pages)"


def _wiki(spark, d) -> DataFrame:
    n = lambda x: F.expr(x).cast("string")
    text = F.concat(F.lit("see [[p-"), n("page_id + 1"), F.lit("]] and [[p-"), n("page_id * 7 % 400"), F.lit("]] or [[Nowhere]]"))
    return table(spark, d, "pages").select(F.concat(F.lit("p-"), n("page_id")).alias("slug"), "page_id", text.alias("text"), "url")


@query("wiki_graph_edges", f"WITH {_WIKI}, l AS (SELECT DISTINCT slug AS src, unnest(regexp_extract_all(text, '\\[\\[([A-Za-z0-9_\\-]+)\\]\\]', 1)) AS dst FROM wiki) SELECT src, dst FROM l WHERE dst IN (SELECT slug FROM wiki)")
def wiki_graph_edges(spark, d):
    return C.wiki_edges(_wiki(spark, d))


@query("wiki_dedupe", f"WITH {_WIKI} SELECT host, slug FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, slug, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1) ORDER BY page_id) AS n FROM wiki) WHERE n = 1")
def wiki_dedupe(spark, d):
    w = _wiki(spark, d).withColumn("host", F.regexp_extract("url", r"://([^/?#]*)", 1))
    return C.first_by(w, "host", "page_id").select("host", "slug")


# Wiki pages of the given ones: the title is that of the HTML, the text begins with front matter in every third, and they were updated day by day.
@query("wiki_lint", """WITH w AS (SELECT page_id, regexp_extract(coalesce(html, ''), '<title>([^<]*)', 1) AS title, CASE WHEN page_id % 3 = 0 THEN '---' || chr(10) || 'a' ELSE 'text' END AS text, CASE WHEN page_id % 50 > 0 THEN TIMESTAMP '2024-06-30' - to_days(CAST(page_id % 200 AS INTEGER)) END AS updated FROM pages)
SELECT page_id, 'missing_title' AS issue FROM w WHERE title = '' UNION ALL SELECT page_id, 'stale' FROM w WHERE updated IS NULL OR updated < TIMESTAMP '2024-06-30' - to_days(90) UNION ALL SELECT page_id, 'missing_frontmatter' FROM w WHERE NOT starts_with(text, '---')""")
def wiki_lint(spark, d):
    now = F.to_timestamp(F.lit("2024-06-30 00:00:00"))
    updated = F.when(F.expr("page_id % 50 > 0"), now - F.make_dt_interval(F.expr("CAST(page_id % 200 AS INT)")))
    text = F.when(F.expr("page_id % 3 = 0"), "---\na").otherwise("text")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("slug"), F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)", 1).alias("title"), text.alias("text"), updated.alias("updated"))
    return C.wiki_issues(pages, now).select(F.col("slug").alias("page_id"), "issue")


@query("trial_count", "SELECT 1 + count(*) FILTER (event_type LIKE 'p%' OR event_type LIKE 'err%') AS n_trials FROM (SELECT event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)")
def trial_count(spark, d):
    last = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    return last.agg((1 + F.count_if(F.startswith("event_type", F.lit("p")) | F.startswith("event_type", F.lit("err")))).alias("n_trials"))


@query("trace_recent", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def trace_recent(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts", "event_type")


@query("trace_parent", "SELECT event_id AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_id FROM events")
def trace_parent(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_id", "id")
    return C.with_parent(e, ["user_id"], ["ts", "id"]).select("id", "parent_id")


_FAILURES = """f AS (SELECT event_id, ts, CASE WHEN event_type IN ('error', 'click') THEN event_type || CASE WHEN event_id % 2 = 0 THEN ': at ' || user_id ELSE '' END END AS error, CASE WHEN event_id % 5 > 0 THEN repeat('s' || event_id || ' ', CAST(event_id % 60 AS INTEGER)) END AS summary, 'h' || user_id AS hypothesis FROM events)"""


@query("failure_lessons", f"""WITH {_FAILURES} SELECT event_id, trim(split_part(error, ':', 1)) AS error_head, CASE WHEN length(coalesce(summary, '')) > 120 THEN left(summary, 117) || '...' ELSE coalesce(summary, '') END AS summary, hypothesis FROM f WHERE lower(trim(split_part(error, ':', 1))) = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20""")
def failure_lessons(spark, d):
    text = lambda c: F.col(c).cast("string")
    error = F.when(F.col("event_type").isin("error", "click"), F.concat("event_type", F.when(F.expr("event_id % 2 = 0"), F.concat(F.lit(": at "), text("user_id"))).otherwise("")))
    summary = F.when(F.expr("event_id % 5 > 0"), F.expr("repeat('s' || event_id || ' ', CAST(event_id % 60 AS INT))"))
    rows = table(spark, d, "events").select("event_id", "ts", error.alias("error"), summary.alias("summary"), F.concat(F.lit("h"), text("user_id")).alias("hypothesis"))
    return C.lessons(rows, "Error: x", 20)


@query("motif_recall", """WITH m AS (SELECT user_id AS signature, list(CASE WHEN event_type = 'purchase' THEN 2.0 ELSE -1.0 END ORDER BY event_id) AS steps FROM events GROUP BY user_id),
w AS (SELECT signature, CAST(list_reduce(list_prepend(0.0, steps), lambda a, x: greatest(-10.0, least(10.0, a + x))) AS DOUBLE) AS weight, 'class' || signature % 4 AS head FROM m) SELECT signature, weight FROM w WHERE head = 'class2' ORDER BY weight DESC, signature LIMIT 7""")
def motif_recall(spark, d):
    """Of the motifs after errors of one class, those of the largest weight."""
    prefix = F.concat(F.lit("class"), F.expr("signature % 4").cast("string"), F.lit(": at "), F.col("signature").cast("string"))
    motifs = C.clamped_weights(_motifs(spark, d)).withColumn("error_prefix", prefix)
    return C.recalled_motifs(motifs, "class2: of now", 7).select("signature", "weight")


@query("audit_verify", """WITH a AS (SELECT user_id AS chain, event_id AS seq, sha256(CAST(event_id AS VARCHAR)) AS hash,
  CASE WHEN event_id % 11 = 0 THEN 'broken' WHEN event_id % 7 = 0 THEN '' ELSE lag(sha256(CAST(event_id AS VARCHAR))) OVER (PARTITION BY user_id ORDER BY event_id) END AS prev_hash FROM events),
l AS (SELECT *, lag(hash) OVER (PARTITION BY chain ORDER BY seq) AS before FROM a)
SELECT chain, count(*) AS n, count(*) FILTER (NOT (coalesce(prev_hash = before, true) OR coalesce(prev_hash, '') = '')) AS n_broken FROM l GROUP BY chain""")
def audit_verify(spark, d):
    digest = F.sha2(F.col("event_id").cast("string"), 256)
    before = F.lag(digest).over(C.Window.partitionBy("user_id").orderBy("event_id"))
    prev = F.when(F.expr("event_id % 11 = 0"), "broken").when(F.expr("event_id % 7 = 0"), "").otherwise(before)
    log = table(spark, d, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("seq"), digest.alias("hash"), prev.alias("prev_hash"))
    return C.audit_breaks(log).groupBy("chain").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("n_broken"))


@query("audit_redact", "SELECT event_id, '***' AS token, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS k FROM events")
def audit_redact(spark, d):
    m = F.create_map(F.lit("Token"), F.lit("abc"), F.lit("k"), F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", C.redacted(m).alias("m")).select("event_id", F.col("m")["Token"].alias("token"), F.col("m")["k"].alias("k"))


@query("audit_redact_nested", """SELECT event_id, '{"a":[{"Api_Key":"***","n":' || user_id || '}],"password":"***","b":{"secret":"***","c":["token",' || event_id || ']}}' AS detail FROM events""")
def audit_redact_nested(spark, d):
    n = lambda c: F.col(c).cast("string")
    detail = F.concat(F.lit('{"a": [{"Api_Key": "x]}", "n": '), n("user_id"), F.lit('}], "password": {"deep": [1, 2]}, "b": {"secret": null, "c": ["token", '), n("event_id"), F.lit("]}}"))
    return table(spark, d, "events").select("event_id", C.redacted_json(detail).alias("detail"))


@query("jobs_active", "SELECT user_id % 10 AS kind, count(*) FILTER (event_type IN ('view', 'click')) AS n_active, count(*) FILTER (event_type IN ('view', 'click')) < 2 AS has_room FROM events GROUP BY 1")
def jobs_active(spark, d):
    active = F.count_if(F.col("event_type").isin("view", "click"))
    return table(spark, d, "events").groupBy(F.expr("user_id % 10").alias("kind")).agg(active.alias("n_active"), (active < 2).alias("has_room"))


@query("job_status_map", """WITH j AS (SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE CASE user_id % 4 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'starting' WHEN 2 THEN '' END END AS state FROM events),
m AS (SELECT *, CASE coalesce(nullif(state, ''), 'pending') WHEN 'queued' THEN 'pending' WHEN 'done' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'cancelled' THEN 'stopped' ELSE coalesce(nullif(state, ''), 'pending') END AS status FROM j)
SELECT event_id, status, status IN ('pending', 'running', 'starting') AS is_active, CASE WHEN status IN ('completed', 'failed', 'stopped') THEN ts END AS ended_at FROM m""")
def job_status_map(spark, d):
    other = F.when(F.expr("user_id % 4 = 0"), "cancelled").when(F.expr("user_id % 4 = 1"), "starting").when(F.expr("user_id % 4 = 2"), "")
    known = {"signup": "queued", "view": "running", "purchase": "done", "error": "error"}
    state = other
    for k, v in known.items():
        state = F.when(F.col("event_type") == k, v).otherwise(state)
    run = C.run_of_job(F.col("state"), F.col("ts"))
    return table(spark, d, "events").withColumn("state", state).select("event_id", *(c.alias(k) for k, c in run.items()))


@query("page_results", "SELECT event_id, ts, (SELECT count(*) FROM events) AS total FROM events ORDER BY ts, event_id LIMIT 25 OFFSET 50")
def page_results(spark, d):
    rows, total, _ = C.page(table(spark, d, "events"), ["ts", "event_id"], 50, 25)
    return rows.select("event_id", "ts", F.lit(total).cast("long").alias("total"))


@query("catalog_upsert", f"""WITH {_CATALOG}, old AS (SELECT * FROM cat WHERE id < 400), new AS (SELECT * FROM cat WHERE id >= 400),
merged AS (SELECT *, 0 AS age FROM old UNION ALL SELECT *, 1 FROM new)
SELECT source, source_ref, arg_min(id, (age, created_at, id)) AS id, arg_min(created_at, (age, created_at, id)) AS created_at, arg_max(name, (age, updated_at, id)) AS name, max(CASE WHEN age = 1 THEN 1 ELSE 0 END) = 1 AS replaced
FROM merged GROUP BY source, source_ref""")
def catalog_upsert(spark, d):
    cat = _catalog(spark, d).withColumn("replaced", F.expr("id >= 400"))
    out = C.upserted(cat.where("id < 400"), cat.where("id >= 400"))
    return out.select("source", "source_ref", "id", "created_at", "name", "replaced")


@query("find_by_hash", f"WITH {_PART_TEXTS} SELECT id FROM texts WHERE k = 0 AND f = 'close' AND n BETWEEN 15 AND 39")
def find_by_hash(spark, d):
    """The parts whose expression has the hash of Rank(Delta(close, 19)), whose window is one of the bucket of 20."""
    rows = part_texts(spark, d)
    return C.with_expr_hash(rows).where(F.col("expr_hash") == X.expr_hash("Rank(Delta($close, 19))")).select("id")


_FACTORS = "f AS (SELECT p_partkey AS id, p_name AS name, (p_size - 25) / 250.0::DOUBLE AS ic, (p_size - 20) / 200.0::DOUBLE AS rank_ic, (p_size % 7 - 3)::DOUBLE AS sharpe, (p_size % 11 - 5) / 10.0::DOUBLE AS ic_ir, CASE WHEN p_size % 13 = 0 THEN 'NaN'::DOUBLE ELSE (p_size % 3 - 1) / 4.0::DOUBLE END AS selection_score, p_brand AS hypothesis, p_partkey % 120 AS n_days, p_partkey % 4 > 0 AS has_returns FROM part)"


def _factors(spark, d) -> DataFrame:
    x = lambda e, a: F.expr(e).cast("double").alias(a)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), x("(p_size - 25) / 250D", "ic"), x("(p_size - 20) / 200D", "rank_ic"), x("p_size % 7 - 3", "sharpe"), x("(p_size % 11 - 5) / 10D", "ic_ir"), x("CASE WHEN p_size % 13 = 0 THEN double('NaN') ELSE (p_size % 3 - 1) / 4D END", "selection_score"), F.col("p_brand").alias("hypothesis"), F.expr("p_partkey % 120").alias("n_days"), F.expr("p_partkey % 4 > 0").alias("has_returns"))


@query("sign_reflect", f"""WITH {_FACTORS} SELECT id, ic + 0.0 AS ic, rank_ic + 0.0 AS rank_ic, CASE WHEN isfinite(selection_score) THEN selection_score + 0.0 END AS selection_score, hypothesis, false AS sign_reflected, NULL::DOUBLE AS reflected_from_t FROM f UNION ALL
SELECT id, -ic + 0.0, -rank_ic + 0.0, CASE WHEN isfinite(selection_score) THEN -selection_score + 0.0 END, hypothesis || ' [sign-mirrored]', true, round(ic_ir * sqrt(n_days), 3) FROM f WHERE ic < 0 AND has_returns AND abs(ic_ir * sqrt(n_days)) >= 3""")
def sign_reflect(spark, d):
    out = pool.sign_reflected(_factors(spark, d))
    plain = lambda c: (S.finite(F.col(c)) + F.lit(0.0)).alias(c)
    return out.select("id", plain("ic"), plain("rank_ic"), plain("selection_score"), "hypothesis", "sign_reflected", "reflected_from_t")


@query("motif_weights", """WITH m AS (SELECT user_id AS signature, list(CASE WHEN event_type = 'purchase' THEN 2.0 ELSE -1.0 END ORDER BY event_id) AS steps, count(*) AS attempts, count(*) FILTER (event_type = 'purchase') AS survived FROM events GROUP BY user_id)
SELECT signature, CAST(list_reduce(list_prepend(0.0, steps), lambda a, x: greatest(-10.0, least(10.0, a + x))) AS DOUBLE) AS weight, attempts, survived FROM m""")
def motif_weights(spark, d):
    return C.clamped_weights(_motifs(spark, d))


def _motifs(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("signature"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("survived"))


@query("motif_topk", """WITH m AS (SELECT user_id AS signature, list(CASE WHEN event_type = 'purchase' THEN 2.0 ELSE -1.0 END ORDER BY event_id) AS steps FROM events GROUP BY user_id)
SELECT signature, CAST(list_reduce(list_prepend(0.0, steps), lambda a, x: greatest(-10.0, least(10.0, a + x))) AS DOUBLE) AS weight FROM m ORDER BY weight DESC, signature LIMIT 5""")
def motif_topk(spark, d):
    return C.clamped_weights(_motifs(spark, d)).orderBy(F.desc("weight"), "signature").limit(5).select("signature", "weight")


@query("next_action", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
e AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'factor' WHEN 'click' THEN 'model' WHEN 'purchase' THEN 'model' WHEN 'error' THEN 'other' END AS action, event_id % 2 = 0 AS ok, event_id % 3 > 0 AS has_returns,
  CASE WHEN event_id % 5 = 0 THEN 'thin' END AS skip, CASE WHEN event_id % 4 > 0 THEN value - 20 END AS sharpe_net, CASE WHEN event_id % 8 > 0 THEN 20 - value END AS portfolio FROM l WHERE rn = 1)
SELECT user_id, CASE WHEN action = 'factor' AND ok AND has_returns THEN 'model' WHEN action = 'model' AND skip IS NULL AND coalesce(sharpe_net, portfolio) > 0 THEN 'model' ELSE 'factor' END AS action FROM e""")
def next_action(spark, d):
    last = C.first_by(table(spark, d, "events"), "user_id", F.desc("ts"), F.desc("event_id"))
    kind = F.when(F.col("event_type") == "view", "factor").when(F.col("event_type").isin("click", "purchase"), "model").when(F.col("event_type") == "error", "other")
    event = {"action": kind, "ok": F.expr("event_id % 2 = 0"), "has_returns": F.expr("event_id % 3 > 0"), "skip_reason": F.when(F.expr("event_id % 5 = 0"), "thin"), "sharpe_net": F.when(F.expr("event_id % 4 > 0"), F.col("value") - 20), "portfolio_return": F.when(F.expr("event_id % 8 > 0"), 20 - F.col("value"))}
    return last.select("user_id", S.next_action(event).alias("action"))


@query("retag_synthetic", "SELECT p_partkey AS id, array_to_string(list_sort(list_distinct([p_type, p_brand] || CASE WHEN p_size % 2 = 0 THEN ['synthetic', p_type] ELSE [] END)), ',') AS tags FROM part")
def retag_synthetic(spark, d):
    base = F.array("p_type", "p_brand")
    tags = F.when(F.expr("p_size % 2 = 0"), F.array_union(base, F.array(F.lit("synthetic")))).otherwise(base)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(F.array_distinct(tags)), ",").alias("tags"))


@query("adversary_tolerance", "SELECT p_partkey AS id, abs((p_retailprice + p_size) - p_retailprice) <= greatest(0.01, 0.05 * abs(p_retailprice)) AS within FROM part")
def adversary_tolerance(spark, d):
    recorded = F.col("p_retailprice")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), G.within_tolerance(recorded, recorded + F.col("p_size")).alias("within"))


# Parts as records: their series are those of the part pool, their panel the one of their brand's suppliers, their code an expression of the part,
# now and then nothing or four times the expression.
@query("evaluate_gates", f"""WITH {_POOL_SERIES}, {_PART_TEXTS}, {DSR_SQL.format(trials=S.chance_factor(TRIALS))}, own AS (SELECT 'p' || p_partkey % {POOL} AS series_id, p_partkey AS id FROM part),
sizes AS (SELECT p_brand, count(DISTINCT l_suppkey) AS n_assets, count(DISTINCT date_trunc('month', l_shipdate)) AS n_days FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
lens AS (SELECT series_id, count(*) AS n_returns FROM series GROUP BY series_id),
pairs AS (SELECT a.series_id AS a, b.series_id AS b, count(*) AS n, covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0) AS corr FROM series a JOIN series b ON a.d = b.d AND a.series_id <> b.series_id WHERE b.series_id IN ('p1', 'p2', 'p3', 'p4', 'p5') GROUP BY 1, 2),
most AS (SELECT a AS series_id, max(corr) FILTER (n >= 10 AND b IN ('p1', 'p2', 'p3')) AS pool_corr, max(corr) FILTER (n >= 10 AND b IN ('p4', 'p5')) AS library_corr FROM pairs GROUP BY a),
codes AS (SELECT id, k, id % 37 = 0 AS empty, id % 29 = 0 AS long, expr FROM texts),
counts AS (SELECT codes.*, CASE WHEN long THEN 4 * sl + 3 ELSE sl END AS sl, CASE WHEN long THEN 4 * pc ELSE pc END AS pc FROM codes LEFT JOIN (VALUES {', '.join(f'({k}, {c[0]}, {c[1]})' for k, c in enumerate(FORM_COUNTS) if c)}) t(k, sl, pc) USING (k)),
f AS (SELECT p_partkey AS id, p_brand, (p_size - 25) / 250.0::DOUBLE AS ic, (p_size % 11 - 5) / 10.0::DOUBLE AS ic_ir FROM part),
r AS (SELECT f.*, n_assets, n_days, coalesce(n_returns, 0) AS n_returns, pool_corr, library_corr, dsr, empty, long, k, expr, sl, pc FROM f JOIN own USING (id) LEFT JOIN sizes USING (p_brand) LEFT JOIN lens USING (series_id) LEFT JOIN most USING (series_id) LEFT JOIN dsr USING (series_id) JOIN counts USING (id))
  SELECT id, array_to_string(list_filter([CASE WHEN id % 13 = 0 THEN 'simulated' END, CASE WHEN coalesce(n_assets < 50 OR n_days < 60, true) THEN 'thin_panel' END, CASE WHEN id % 23 = 0 THEN 'missing_ic' WHEN abs(ic) <= 0.005 THEN 'ic_threshold' END, CASE WHEN n_returns = 0 THEN 'missing_returns' END,
  CASE WHEN n_returns > 0 AND pool_corr > 0.7 THEN 'correlated' END, CASE WHEN n_returns > 0 AND id % 31 = 0 THEN 'corr_error:no pool' END, CASE WHEN empty THEN 'empty_code' END, CASE WHEN n_returns > 0 AND abs(ic_ir * sqrt(n_returns)) < 3 THEN 'weak_ic' END, CASE WHEN dsr < 0.95 THEN 'inflated_sharpe' END,
  CASE WHEN NOT empty AND NOT long AND expr IN ({_KNOWN}) AND k <> 7 THEN 'homogeneous' END, CASE WHEN NOT empty AND k <> 7 AND (sl > 40 OR pc > 6) THEN 'overcomplex' END], lambda x: x IS NOT NULL), ',') AS failures FROM r""")
def evaluate_gates(spark, d):
    series = saved(pool_series(spark, d), "series")
    part, items = table(spark, d, "part"), table(spark, d, "lineitem")
    sizes = items.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("p_brand").agg(F.count_distinct("l_suppkey").alias("n_assets"), F.count_distinct(F.trunc("l_shipdate", "month")).alias("n_days"))
    lens = series.groupBy("series_id").agg(F.count("*").alias("n_returns"))
    members = {"pool_corr": ["p1", "p2", "p3"], "library_corr": ["p4", "p5"]}
    most = S.correlations_with(series, [m for ms in members.values() for m in ms])
    most = most.groupBy(F.col("b").alias("series_id")).agg(*(F.max(F.when(F.col("a").isin(ms), F.col("corr"))).alias(k) for k, ms in members.items()))
    every = lambda k: F.expr(f"id % {k} = 0")
    four = F.when(every(29), F.array_join(F.array_repeat("expr", 4), " + ")).otherwise(F.col("expr"))
    codes = saved(part_texts(spark, d).select("id", F.when(every(37), " ").otherwise(four).alias("expr")), "codes")
    alike = T.most_similar(codes, spark.createDataFrame([(t,) for t in GATE_CORPUS], "expr string"))
    codes = codes.join(T.described(codes).select("expr", "sl", "pc", "fc"), "expr").join(alike, "expr", "left")
    f = part.select(F.col("p_partkey").alias("id"), "p_brand", F.concat(F.lit("p"), F.expr(f"p_partkey % {POOL}").cast("string")).alias("series_id"), F.expr("(p_size - 25) / 250D").alias("ic"), F.expr("(p_size % 11 - 5) / 10D").alias("ic_ir"))
    f = f.join(sizes, "p_brand", "left").join(lens, "series_id", "left").join(most, "series_id", "left").join(S.deflated_sharpe(series, TRIALS), "series_id", "left").join(codes.withColumnRenamed("expr", "code"), "id")
    record = {c: F.col(c) for c in ("n_assets", "n_days", "n_returns", "pool_corr", "library_corr", "code", "ic_ir", "dsr", "similarity", "sl", "pc", "fc")}
    record |= {"simulated": every(13), "formula_proxy": F.lit(False), "ic": F.when(every(23), float("nan")).otherwise(F.col("ic")), "corr_error": F.when(every(31), "no pool")}
    return f.select("id", F.array_join(G.failures(record, "to_pool"), ",").alias("failures"))


def _named(spark, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("pool_cull", f"""WITH RECURSIVE {_POOL_SERIES}, {_POOL_FACTORS},
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS k FROM factors WHERE NOT simulated AND abs(ic) > 0.005),
close AS MATERIALIZED (SELECT greatest(x.k, y.k) AS k, list(least(x.k, y.k)) AS earlier FROM (SELECT a.series_id AS a, b.series_id AS b, covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0) AS corr FROM series a JOIN series b ON a.d = b.d AND a.series_id < b.series_id GROUP BY 1, 2 HAVING count(*) >= 10) p
  JOIN ranked x ON x.name = p.a JOIN ranked y ON y.name = p.b WHERE x.profile = y.profile AND corr * (CASE WHEN x.ic >= 0 THEN 1 ELSE -1 END) * (CASE WHEN y.ic >= 0 THEN 1 ELSE -1 END) > 0.7 GROUP BY 1),
step AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT step.k + 1, CASE WHEN len(list_intersect(kept, coalesce(earlier, []::BIGINT[]))) = 0 THEN list_append(kept, step.k + 1) ELSE kept END FROM step LEFT JOIN close ON close.k = step.k + 1 WHERE step.k < (SELECT max(k) FROM ranked))
SELECT name FROM ranked WHERE list_contains((SELECT kept FROM step ORDER BY k DESC LIMIT 1), k)""")
def pool_cull(spark, d):
    series = saved(pool_series(spark, d), "series")
    return _named(spark, [(n,) for n in pool.pool_cull(pool_factors(spark, d), series)], "name string")


SAMPLES = 5


def _sampling() -> str:
    """SQL of the choices one after the other: pick_k, and the largest distance of every name to the picks so far, near_k."""
    picks = ["pick_0 AS (SELECT name FROM c WHERE k = 1)", "near_0 AS (SELECT c.name, c.k, coalesce(v, 1) AS near FROM c LEFT JOIN dist ON a = c.name AND b = (SELECT name FROM pick_0))"]
    for i in range(1, SAMPLES):
        taken = " UNION ALL ".join(f"SELECT name FROM pick_{j}" for j in range(i))
        picks.append(f"pick_{i} AS MATERIALIZED (SELECT name FROM near_{i - 1} WHERE name NOT IN ({taken}) ORDER BY near, k LIMIT 1)")
        picks.append(f"near_{i} AS MATERIALIZED (SELECT n.name, n.k, greatest(near, coalesce(v, 1)) AS near FROM near_{i - 1} n LEFT JOIN dist ON a = n.name AND b = (SELECT name FROM pick_{i}))")
    return ", ".join(picks)


@query("diverse_samples", f"""WITH {_POOL_SERIES}, {_POOL_FACTORS},
c AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY abs(ic) DESC, name) AS k FROM factors WHERE status <> 'culled' AND name IN (SELECT series_id FROM series)),
dist AS MATERIALIZED (SELECT a.series_id AS a, b.series_id AS b, CASE WHEN count(*) >= 10 THEN abs(covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0)) END AS v FROM series a JOIN series b ON a.d = b.d AND a.series_id <> b.series_id GROUP BY 1, 2),
{_sampling()} {' UNION ALL '.join(f'SELECT {i} AS rank, name FROM pick_{i}' for i in range(SAMPLES))}""")
def diverse_samples(spark, d):
    series = saved(pool_series(spark, d), "series")
    return _named(spark, list(enumerate(pool.diverse_samples(pool_factors(spark, d), series, SAMPLES))), "rank int, name string")

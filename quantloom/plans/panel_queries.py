"""Queries over panels: scans, the expression language and factor templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import expressions as X
from quantloom.functions import rolling as R
from quantloom.operators import scores
from quantloom.operators import structure as T
from quantloom.plans.registry import PANEL, SERIES, over_panel, query, rolling
from quantloom.sources import panel as P

CONSTITUENTS = """
later AS (
  SELECT ts_code, volume, CAST(trade_date + to_months(CAST(k AS INTEGER)) AS DATE) AS as_of FROM p, range(1, 7) AS t(k)
), cons AS (
  SELECT as_of, ts_code FROM (
    SELECT as_of, ts_code, row_number() OVER (PARTITION BY as_of ORDER BY sum(volume) DESC, ts_code) AS rn
    FROM later WHERE month(as_of) IN (6, 12) AND as_of <= (SELECT max(trade_date) FROM p) GROUP BY as_of, ts_code
  ) WHERE rn <= 22
)"""


def members(panel: DataFrame) -> DataFrame:
    return P.constituents(panel, 22)


@query("scan_years_complete", f"""WITH {PANEL}
SELECT CAST(y AS INTEGER) AS year, count(p.trade_date) AS n_rows, count(p.trade_date) > 0 AS complete
FROM range(1994, 2003) AS t(y) LEFT JOIN p ON year(p.trade_date) = y GROUP BY y""")
def scan_years_complete(spark, d):
    return P.year_cover(P.brand_panel(spark, d), 1994, 2002)


@query("panel_date_range", f"WITH {PANEL} SELECT min(trade_date) AS first_day, max(trade_date) AS last_day FROM p")
def panel_date_range(spark, d):
    return P.brand_panel(spark, d).agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))


@query("panel_stats", f"""WITH {PANEL} SELECT count(DISTINCT ts_code) AS n_assets, count(DISTINCT trade_date) AS n_days, min(trade_date) AS first_day,
  max(trade_date) AS last_day, count(DISTINCT ts_code) < 50 OR count(DISTINCT trade_date) < 60 AS thin FROM p""")
def panel_stats(spark, d):
    return P.stats(P.brand_panel(spark, d))


@query("flatten_components", f"WITH {PANEL}, {CONSTITUENTS} SELECT DISTINCT ts_code FROM cons")
def flatten_components(spark, d):
    return P.flattened(members(P.brand_panel(spark, d)))


@query("union_years", f"WITH {PANEL} SELECT trade_date, ts_code, close, volume FROM p WHERE year(trade_date) IN (1996, 1997)")
def union_years(spark, d):
    p = P.brand_panel(spark, d).select("trade_date", "ts_code", "close", "volume")
    return p.where(F.year("trade_date") == 1996).unionByName(p.where(F.year("trade_date") == 1997))


def _expression(name: str, text: str, value: str, source: str = "p", ctes: str = "") -> None:
    sql = f"WITH {PANEL}{ctes} SELECT trade_date, ts_code, round({value}, 6) AS value FROM {source}"

    @query(name, sql)
    def run(spark, d):
        return P.brand_panel(spark, d).select("trade_date", "ts_code", F.round(X.compiled(text), 6).alias("value"))


_expression("expr_arith", "(close - open) * 2 + high - -low ** 0.5", "(close - open) * 2 + high - (-(low ** 0.5))")
_expression("expr_div", "Div(high - low, open - low) + close / volume", "(high - low) / nullif(open - low, 0) + close / nullif(volume, 0)")
_expression("expr_math", "Abs(close - open) + Log(volume) * Sign(open - close)", "abs(close - open) + CASE WHEN volume > 0 THEN ln(volume) END * sign(open - close)")
_expression("expr_compare", "Greater(close, open) - Less(volume, 800) * 2", "CAST(close > open AS DOUBLE) - CAST(volume < 800 AS DOUBLE) * 2")
_expression("expr_if", "If(Greater(close, open), high, low)", "CASE WHEN close > open THEN high ELSE low END")
_expression("ts_ref", "Ref(close, 3)", f"lag(close, 3) OVER ({SERIES})")
_expression("ts_delta", "Delta(close, 5)", f"close - lag(close, 5) OVER ({SERIES})")
_expression("ts_mean", "Mean(close, 5)", rolling("avg", "close", 5))
_expression("ts_std", "Std(close, 10)", rolling("stddev_samp", "close", 10))
_expression("ts_sum", "Sum(volume, 5)", rolling("sum", "volume", 5))
_expression("ts_max", "Max(high, 20)", rolling("max", "high", 20))
_expression("ts_min", "Min(low, 20)", rolling("min", "low", 20))
_W10 = f"OVER ({SERIES} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_expression("ts_corr", "Corr(close, volume, 10)", f"CASE WHEN count(*) {_W10} = 10 AND stddev_pop(close) {_W10} * stddev_pop(volume) {_W10} > 1e-12 THEN covar_pop(close, volume) {_W10} / nullif(stddev_pop(close) {_W10} * stddev_pop(volume) {_W10}, 0) END")
_expression("ts_median", "Median(close, 6)", rolling("median", "close", 6))
_EMA = f"list_reduce(list(close) OVER ({SERIES} ROWS UNBOUNDED PRECEDING), lambda e, v: e + (v - e) * 2 / 13.0::DOUBLE)"
_expression("ts_ema", "EMA(close, 12)", _EMA)
_expression("cs_zscore", "CSZScore(volume)", "(volume - avg(volume) OVER (PARTITION BY trade_date)) / nullif(stddev_samp(volume) OVER (PARTITION BY trade_date), 0)")
_expression("cs_rank", "Rank(close)", "CAST(row_number() OVER (PARTITION BY trade_date ORDER BY close, ts_code) AS DOUBLE)")
_expression("cs_rank_pct", "CSRank(low)", "(rank() OVER (PARTITION BY trade_date ORDER BY low) + (count(*) OVER (PARTITION BY trade_date, low) - 1) / 2) / count(*) OVER (PARTITION BY trade_date)")
_expression(
    "expr_nested",
    "Rank(Mean(Delta(close, 1), 10))",
    "CASE WHEN m IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY trade_date ORDER BY m NULLS LAST, ts_code) AS DOUBLE) END",
    "m",
    f", a AS (SELECT *, close - lag(close, 1) OVER ({SERIES}) AS x FROM p), m AS (SELECT *, {rolling('avg', 'x', 10)} AS m FROM a)",
)


def _template(name: str, template: str, field: str, window: int, value: str) -> None:
    @query(name, over_panel(value))
    def run(spark, d):
        return P.brand_panel(spark, d).select("trade_date", "ts_code", F.round(scores.raw(template, field, window), 6).alias("value"))


def _prev(agg: str, f: str, w: int) -> str:
    return rolling(agg, f, w, 1)


_template("tpl_mom", "mom", "close", 10, f"close - lag(close, 10) OVER ({SERIES})")
_template("tpl_rev", "rev", "high", 5, f"-(high - lag(high, 5) OVER ({SERIES}))")
_template("tpl_ma_dist", "ma_dist", "close", 10, f"close - ({_prev('avg', 'close', 10)})")
_template("tpl_zma", "zma", "close", 10, f"(close - ({_prev('avg', 'close', 10)})) / (({_prev('stddev_samp', 'close', 10)}) + 1e-12)")
_template("tpl_shock", "shock", "amount", 5, f"amount / (({_prev('avg', 'amount', 5)}) + 1e-12)")
_template("tpl_compression", "compression", "close", 10, f"-(({rolling('max', 'close', 10)}) - ({rolling('min', 'close', 10)}))")


def ranked(value: str, name: str = "score") -> str:
    """SQL for (trade_date, ts_code, score): ordinal rank of a raw value, null where that is null."""
    return f"""SELECT trade_date, ts_code, CASE WHEN raw IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY trade_date ORDER BY raw NULLS LAST, ts_code) AS DOUBLE) END AS {name}
FROM (SELECT trade_date, ts_code, {value} AS raw FROM p)"""


SEED_SQL = {
    "rank_delta_20": f"close - lag(close, 20) OVER ({SERIES})",
    "reversal_5": f"-(close - lag(close, 5) OVER ({SERIES}))",
    "vp_shock": f"volume / (({_prev('avg', 'volume', 20)}) + 1e-12)",
}
for _key, _name in (("seed_rank_delta", "rank_delta_20"), ("seed_reversal", "reversal_5"), ("seed_vp_shock", "vp_shock")):

    @query(_key, f"WITH {PANEL} {ranked(SEED_SQL[_name])}")
    def _seed(spark, d, name=_name):
        return scores.score(P.brand_panel(spark, d), *scores.SEEDS[name])


FORWARD = f"SELECT trade_date, ts_code, lead(close, 1) OVER ({SERIES}) / nullif(close, 0) - 1 AS fwd FROM p"


@query("forward_return", f"WITH {PANEL} SELECT trade_date, ts_code, round(fwd, 6) AS fwd FROM ({FORWARD})")
def forward_return(spark, d):
    return scores.forward_returns(P.brand_panel(spark, d)).withColumn("fwd", F.round("fwd", 6))


SWEEP = [("mom", "close", 5), ("zma", "volume", 10), ("compression", "high", 5), ("shock", "amount", 10)]
SWEEP_SQL = {
    "mom_close_5": f"close - lag(close, 5) OVER ({SERIES})",
    "zma_volume_10": f"(volume - ({_prev('avg', 'volume', 10)})) / (({_prev('stddev_samp', 'volume', 10)}) + 1e-12)",
    "compression_high_5": f"-(({rolling('max', 'high', 5)}) - ({rolling('min', 'high', 5)}))",
    "shock_amount_10": f"amount / (({_prev('avg', 'amount', 10)}) + 1e-12)",
}


@query("sweep_scores", f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT '{k}' AS factor, * FROM ({ranked(v)})" for k, v in SWEEP_SQL.items()))
def sweep_scores(spark, d):
    return scores.score_many(P.brand_panel(spark, d), SWEEP)


_GRID_TEMPLATES = ", ".join(f"('{t}')" for t in scores.TEMPLATES)
_GRID_FIELDS = ", ".join(f"('{f}')" for f in scores.GRID_FIELDS)
_GRID_WINDOWS = ", ".join(f"({w})" for w in scores.GRID_WINDOWS)


@query("sweep_grid", f"""WITH {PANEL.replace("p_brand AS ts_code", "CAST(l_suppkey AS VARCHAR) AS ts_code").replace("FROM lineitem JOIN part ON l_partkey = p_partkey", "FROM lineitem")},
held AS (SELECT unnest(['close', 'open', 'high', 'low', 'volume', 'amount']) AS field, unnest([count(close), count(open), count(high), count(low), count(volume), count(amount)]) AS n_values FROM p)
SELECT template, field, CAST(w AS INTEGER) AS window_size, n_values FROM (VALUES {_GRID_TEMPLATES}) a(template), (VALUES {_GRID_FIELDS}) b(field) JOIN held USING (field), (VALUES {_GRID_WINDOWS}) c(w) WHERE NOT (template = 'compression' AND field = 'amount')""")
def sweep_grid(spark, d):
    """The candidates, and how many values the supplier panel has for each."""
    p = P.supplier_panel(spark, d)
    held = p.agg(*(F.count(c).alias(c) for c in P.FIELDS[2:])).unpivot([], P.FIELDS[2:], "field", "n_values")
    return spark.createDataFrame(scores.sweep_grid(), "template string, field string, window_size int").join(held, "field")


_NEUTRAL = f"WITH {PANEL}, s AS ({ranked(SEED_SQL['reversal_5'])}), a AS ({ranked(SEED_SQL['rank_delta_20'], 'a')}), b AS ({ranked(SEED_SQL['vp_shock'], 'b')})"
_JOINED = "SELECT trade_date, ts_code, s.score AS y, a.a AS a, b.b AS b FROM s JOIN a USING (trade_date, ts_code) JOIN b USING (trade_date, ts_code) WHERE s.score IS NOT NULL AND a.a IS NOT NULL AND b.b IS NOT NULL"


def _three(spark, d) -> DataFrame:
    """Three seeds side by side, from one pass instead of joins."""
    p = P.brand_panel(spark, d)
    named = {"score": "reversal_5", "a": "rank_delta_20", "b": "vp_shock"}
    wide = p.select("trade_date", "ts_code", *(scores.raw(*scores.SEEDS[n]).alias(k) for k, n in named.items()))
    return wide.select("trade_date", "ts_code", *(R.rank(F.col(k)).alias(k) for k in named))


@query("neutralize_join", f"{_NEUTRAL} SELECT trade_date, ts_code, y AS score, a, b FROM ({_JOINED})")
def neutralize_join(spark, d):
    p = P.brand_panel(spark, d)
    s, a, b = (scores.score(p, *scores.SEEDS[n]) for n in ("reversal_5", "rank_delta_20", "vp_shock"))
    keys = ["trade_date", "ts_code"]
    return s.join(a.withColumnRenamed("score", "a"), keys).join(b.withColumnRenamed("score", "b"), keys).dropna()


@query("neutralize_1", f"""{_NEUTRAL}, j AS (SELECT trade_date, ts_code, s.score AS y, a.a AS a FROM s JOIN a USING (trade_date, ts_code) WHERE s.score IS NOT NULL AND a.a IS NOT NULL),
m AS (SELECT trade_date, avg(y) AS my, avg(a) AS ma, covar_pop(a, y) AS c, var_pop(a) AS v FROM j GROUP BY trade_date)
SELECT trade_date, ts_code, round(y - my - coalesce(c / nullif(v, 0), 0) * (a - ma), 6) + 0.0 AS score FROM j JOIN m USING (trade_date)""")
def neutralize_1(spark, d):
    rows = _three(spark, d).select("trade_date", "ts_code", "score", "a")
    return scores.neutralised(rows, ["a"]).withColumn("score", F.round("score", 6) + F.lit(0.0))


@query("neutralize_2", f"""{_NEUTRAL}, j AS ({_JOINED}),
m AS (SELECT trade_date, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS b_y FROM j GROUP BY trade_date)
SELECT trade_date, ts_code, round(y - my - (ay * bb - b_y * ab) / (aa * bb - ab * ab) * (a - ma) - (b_y * aa - ay * ab) / (aa * bb - ab * ab) * (b - mb), 6) + 0.0 AS score FROM j JOIN m USING (trade_date)""")
def neutralize_2(spark, d):
    return scores.neutralised(_three(spark, d), ["a", "b"]).withColumn("score", F.round("score", 6) + F.lit(0.0))


ZOO = [
    "Rank(Mean(open, 8) - Mean(open, 30))",
    "-Rank(Ref(high, 3) / low)",
    "CSRank(Sum(amount, 12) / Sum(volume, 12))",
    "Rank(Corr(amount, high, 25)) + Rank(Delta(low, 4))",
    "Sign(Less(vwap, Mean(vwap, 15))) * Abs(Delta(open, 2))",
    "Log(Max(amount, 40)) - Log(Min(amount, 40))",
    "If(Greater(high, Ref(high, 6)), Std(low, 12), -Std(low, 24))",
]

# Expressions of the parts: eight forms over fields and windows that type, brand and size give, some with an unlisted operator or none.
FORMS = ["Rank(Delta({f}, {n}))", "Rank(Mean({f}, {n}) - Mean({g}, {m}))", "-Rank(Corr({f}, {g}, {n}))", "Div({f}, Ref({f}, {n})) - 1", "Rank(Rank(Std({f}, {n}))) * Sign(Delta({g}, {m}))", "Foo({f}, {n})", "If(Greater({f}, {g}), Mean({f}, {n}), -Mean({g}, {n}))", "Rank(Delta({f}, {n})"]
#: Size, numbers and fields of each form, where f and g are different fields; the last doesn't parse.
FORM_COUNTS = [(5, 1, 1), (10, 2, 2), (8, 1, 2), (10, 2, 1), (12, 2, 2), (4, 1, 1), (15, 2, 2), None]
_PART_FIELDS = ["close", "open", "high", "low", "volume", "amount"]


def _filled(form: str) -> str:
    """SQL of a form's text."""
    out = "'" + form + "'"
    for mark, sql in (("{f}", "f"), ("{g}", "g"), ("{n}", "n"), ("{m}", "m")):
        out = out.replace(mark, f"' || {sql} || '")
    return out


_PART_TEXTS = f"""x AS (SELECT p_partkey AS id, p_size, p_partkey % {len(FORMS)} AS k, [{', '.join(f"'{f}'" for f in _PART_FIELDS)}] AS fields, p_size % 6 + 1 AS i, CAST(substr(p_brand, 7) AS INTEGER) % 6 + 1 AS j FROM part),
y AS (SELECT id, p_size, k, fields[i] AS f, fields[j] AS g, i <> j AS two, p_size AS n, p_size % 7 + 2 AS m FROM x),
texts AS (SELECT *, CASE k {' '.join(f'WHEN {k} THEN {_filled(t)}' for k, t in enumerate(FORMS))} END AS expr FROM y)"""


def part_texts(spark, d) -> DataFrame:
    """id, place, expr of every part."""
    fields = F.array(*map(F.lit, _PART_FIELDS))
    of = lambda i: F.element_at(fields, i.cast("int"))
    marks = {"{f}": of(F.col("p_size") % 6 + 1), "{g}": of(F.substr("p_brand", F.lit(7)).cast("int") % 6 + 1), "{n}": F.col("p_size").cast("string"), "{m}": (F.col("p_size") % 7 + 2).cast("string")}
    text = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("p_partkey") % len(FORMS) + 1).cast("int"))
    for mark, value in marks.items():
        text = F.replace(text, F.lit(mark), value)
    return P.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("place"), text.alias("expr"))


def _described(spark, d) -> DataFrame:
    rows = part_texts(spark, d)
    return rows.join(T.described(rows), "expr")


_LISTED = ", ".join(f"'{t}'" for t in X.LISTED)


@query("expr_is_listed", f"WITH {_PART_TEXTS} SELECT id, len(list_filter(regexp_extract_all(expr, '([A-Za-z_]\\w*)\\s*\\(', 1), lambda x: x NOT IN ({_LISTED}))) = 0 AS listed FROM texts")
def expr_is_listed(spark, d):
    return _described(spark, d).select("id", "listed")


@query("expr_translate", f"WITH {_PART_TEXTS} SELECT id, expr AS plain, CASE WHEN k <> 5 THEN regexp_replace(expr, '\\b(close|open|high|low|volume|amount)\\b', '$\\1', 'g') END AS dollar FROM texts")
def expr_translate(spark, d):
    return _described(spark, d).select("id", "plain", "dollar")


@query("expr_validate", f"WITH {_PART_TEXTS} SELECT id, k NOT IN (5, 7) AS valid FROM texts")
def expr_validate(spark, d):
    return _described(spark, d).select("id", "valid")


@query("expr_complexity", f"""WITH {_PART_TEXTS}, c AS (SELECT * FROM (VALUES {', '.join(f'({k}, {c[0]}, {c[1]}, {c[2]})' for k, c in enumerate(FORM_COUNTS) if c)}) t(k, sl, pc, fc))
SELECT id, sl, pc, CAST(CASE WHEN fc = 2 AND NOT two THEN 1 ELSE fc END AS INTEGER) AS fc FROM texts LEFT JOIN c USING (k)""")
def expr_complexity(spark, d):
    return _described(spark, d).select("id", "sl", "pc", "fc")


# Of the forms with one window, the hash tells windows apart by their bucket only.
@query("expr_hash", f"""WITH {_PART_TEXTS}, b AS (SELECT *, CASE WHEN n < 3 THEN 1 WHEN n < 7.5 THEN 5 WHEN n < 15 THEN 10 WHEN n < 40 THEN 20 ELSE 60 END AS bucket FROM texts WHERE k IN (0, 5))
SELECT id, min(id) OVER (PARTITION BY k, f, bucket) AS first_alike FROM b""")
def expr_hash(spark, d):
    first = F.min("id").over(R.Window.partitionBy("hash"))
    return _described(spark, d).where("id % 8 IN (0, 5)").select("id", first.alias("first_alike"))


@query("window_bucket", "SELECT p_partkey AS id, CAST(CASE WHEN v < 3 THEN 1 WHEN v < 7.5 THEN 5 WHEN v < 15 THEN 10 WHEN v < 40 THEN 20 WHEN v < 90 THEN 60 WHEN v < 180 THEN 120 ELSE 240 END AS INTEGER) AS bucket FROM (SELECT p_partkey, p_size * 6 / 2.0 - 2 AS v FROM part)")
def window_bucket(spark, d):
    return P.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.bucket_of(F.col("p_size") * 6 / 2 - 2).alias("bucket"))


def _zoo(spark) -> DataFrame:
    return spark.createDataFrame([(t,) for t in ZOO], "expr string")


@query("expr_similarity")
def expr_similarity(spark, d):
    """All pairs of classes of the parts' expressions that are more alike than 0.55: mostly one form over the same fields with other windows."""
    of = T.classes(part_texts(spark, d), 0.55)
    text = of.groupBy("class").agg(F.min("expr").alias("expr"))
    pairs = T.alike(of, 0.55)
    pairs = pairs.join(text.select(F.col("class").alias("a"), F.col("expr").alias("expr_a")), "a").join(text.select(F.col("class").alias("b"), F.col("expr").alias("expr_b")), "b")
    return pairs.select(F.least("expr_a", "expr_b").alias("a"), F.greatest("expr_a", "expr_b").alias("b"), F.round("similarity", 6).alias("similarity"))


@query("expr_most_similar")
def expr_most_similar(spark, d):
    rows = part_texts(spark, d)
    return rows.join(T.most_similar(rows, _zoo(spark)), "expr").select("id", F.round("similarity", 6).alias("similarity"))


@query("structural_dedup")
def structural_dedup(spark, d):
    return T.structural_dedup(part_texts(spark, d), _zoo(spark)).select("id", "expr")

"""Boosted heads, expressions in tables, chains, job logs, sweeps with bad candidates, SQLite, year syncs, cached results and limits of user code."""

import datetime
import itertools
import math
import os
import random
import sqlite3

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from quantloom.functions import expressions as X
from quantloom.operators import boosting as B
from quantloom.operators import cache, chains, jobs, pool, records, user_code
from quantloom.operators import evaluation as E
from quantloom.operators import series as S
from quantloom.operators import structure as T
from quantloom.operators.links import groups, running_total
from quantloom.sources import sqlite, sync
from quantloom.streaming import jobs as job_stream

DAY = datetime.date(2020, 1, 1)


# --- heads --------------------------------------------------------------------------------------------


def tree(x, y, depth, least, scale):
    """A function from a row to the mean of its leaf, by a plain search over all cuts."""
    best = None
    if depth:
        for j in range(x.shape[1]):
            for low, high in itertools.pairwise(np.unique(x[:, j])):
                left = x[:, j] <= low
                n, m = left.sum(), (~left).sum()
                if n >= least and m >= least:
                    gain = y[left].sum() ** 2 / n + y[~left].sum() ** 2 / m - y.sum() ** 2 / len(y)
                    if best is None or gain > best[0] + B.NEAR * abs(best[0]):
                        best = gain, j, (low + high) / 2
    if best is None or best[0] <= B.ROUNDING * scale:
        mean = y.mean()
        return lambda row: mean
    _, j, cut = best
    left = x[:, j] <= cut
    low, high = (tree(x[side], y[side], depth - 1, least, scale) for side in (left, ~left))
    return lambda row: low(row) if row[j] <= cut else high(row)


def boosted_by_brute_force(values, rounds, rate, depth, least):
    x, y = B.lagged(np.asarray(values, float))
    out = []
    for t in range(B.LEAST_TRAIN, len(y)):
        pred, at = y[:t].mean(), np.full(t, y[:t].mean())
        scale = ((y[:t] - at) ** 2).sum()
        for _ in range(rounds):
            f = tree(x[:t], y[:t] - at, depth, least, scale)
            at = at + rate * np.array([f(r) for r in x[:t]])
            pred += rate * f(x[t])
        out.append(pred)
    return out


SERIES = {
    "random": lambda rng: rng.normal(0, 0.02, 60),
    "flat": lambda rng: np.full(50, 0.01),
    "zigzag": lambda rng: np.where(np.arange(60) % 2, 0.02, -0.02),
    "few values": lambda rng: rng.integers(-2, 3, 60) / 100,
    "trend": lambda rng: np.arange(60) / 1000 + rng.normal(0, 0.001, 60),
}


@pytest.mark.parametrize("name", SERIES)
def test_boosting_equals_a_refit(name):
    values = SERIES[name](np.random.default_rng(3))
    x, y = B.lagged(values)
    kw = {"rounds": 8, "rate": 0.3, "depth": 3, "least": 5}
    steps = np.arange(B.LEAST_TRAIN, len(y))
    got = np.concatenate([B.predictions(x, y, part, int(part[0]), **kw) for part in np.array_split(steps, 3)])
    assert np.allclose(got, boosted_by_brute_force(values, **kw), atol=1e-9)


def test_boosting_of_many_series_side_by_side():
    rng = np.random.default_rng(4)
    values = [rng.normal(0, 0.02, n) for n in (40, 70, 55, 20)] + [f(rng) for f in SERIES.values()]
    kw = {"rounds": 8, "rate": 0.3, "depth": 3, "least": 5}
    parts = [B.lagged(np.asarray(v, float)) for v in values]
    got = B.side_by_side([(x, y, np.arange(B.LEAST_TRAIN, len(y)), B.LEAST_TRAIN) for x, y in parts], **kw)
    for v, pred in zip(values, got, strict=True):
        assert np.allclose(pred, boosted_by_brute_force(v, **kw), atol=1e-9)


def test_boosting_with_few_bins_does_not_look_ahead():
    rng = np.random.default_rng(5)
    values = rng.normal(0, 0.02, 90)
    x, y = B.lagged(values)
    one = B.predictions(x, y, np.arange(50, 70), 50, rounds=5, least=5, bins=8)
    y2, x2 = y.copy(), x.copy()
    y2[70:], x2[71:] = 9.0, 9.0
    assert np.array_equal(one, B.predictions(x2, y2, np.arange(50, 70), 50, rounds=5, least=5, bins=8))
    assert len(np.unique(one)) > 5


def test_boosted_head_over_series(spark, monkeypatch):
    monkeypatch.setattr(B, "STEPS", 16)
    rng = np.random.default_rng(1)
    rows = [(k, DAY + datetime.timedelta(days=i), float(v)) for k in ("a", "b") for i, v in enumerate(rng.normal(0, 0.02, 70))]
    rows += [("short", DAY + datetime.timedelta(days=i), 0.1) for i in range(B.LEAST_SERIES - 1)] + [("a", DAY + datetime.timedelta(days=200), float("nan")), ("b", DAY + datetime.timedelta(days=201), None)]
    df = spark.createDataFrame(rows, "series_id string, d date, r double")
    got = S.head(df, "gbm").orderBy("series_id", "d").toPandas()
    assert list(got.groupby("series_id").size()) == [55, 55]
    for k in ("a", "b"):
        values = [r for s, _, r in rows if s == k and r is not None and r == r]
        x, y = B.lagged(np.array(values))
        own = got[got.series_id == k]
        assert np.allclose(own.pred, B.predictions(x, y, np.arange(10, 65), 10))
        assert np.allclose(own.nav, np.cumprod(1 + own.pred * y[10:]))


def test_ols_head_has_the_least_norm(spark):
    rng = np.random.default_rng(2)
    t = np.arange(30)
    values = {"flat": np.full(30, 0.01), "zero": np.zeros(30), "zigzag": np.where(t % 2, 0.02, -0.02), "shifted": np.where(t % 2, 0.03, -0.01), "random": rng.normal(0, 0.02, 30), "line": t / 1000.0, "spike": np.r_[np.zeros(29), 1.0]}
    df = spark.createDataFrame([(k, DAY + datetime.timedelta(days=i), float(v)) for k, vs in values.items() for i, v in enumerate(vs)], "series_id string, d date, r double")
    got = {r["series_id"]: (r["b0"], r["b1"], r["b2"]) for r in S.ols_head(df).collect()}
    for k, v in values.items():
        want = np.linalg.lstsq(np.column_stack([np.ones(28), v[1:-1], v[:-2]]), v[2:], rcond=None)[0]
        assert np.allclose(got[k], want, atol=1e-8), k


# --- expressions in tables ----------------------------------------------------------------------------


def expressions(n, seed=4):
    rng = random.Random(seed)
    field = lambda: rng.choice(["close", "open", "high", "$volume"])

    def make(depth):
        if depth == 0:
            return field()
        k = rng.randrange(7)
        a, b, w = make(depth - 1), make(rng.randrange(depth)), rng.choice([3, 5, 20])
        return [f"Rank({a})", f"Rank(Rank({a}))", f"Corr({a}, {b}, {w})", f"Mean({a}, {w})", f"({a} + {b})", f"-Delta({a}, {w})", f"If(Greater({a}, {b}), {a}, {w})"][k]

    return [make(rng.randint(1, 4)) for _ in range(n)] + ["Rank(", "", "close", "close", "Rank(Rank(Rank(Rank(close))))", "Rank(close)"]


def test_pairs_above_the_threshold_are_all_found(spark):
    texts = expressions(220)
    of = T.classes(spark.createDataFrame([(t,) for t in texts], "expr string"))
    named = {r["expr"]: r["class"] for r in of.collect()}
    for most in (0.85, 0.6):
        of = T.classes(spark.createDataFrame([(t,) for t in texts], "expr string"), most)
        got = {(r["a"], r["b"]): r["similarity"] for r in T.alike(of, most).collect()}
        want = {}
        for a, b in itertools.combinations(sorted(named), 2):
            s = X.similarity(X.parse(a), X.parse(b))
            if named[a] == named[b]:
                assert s == 1
            elif s > most:
                want[tuple(sorted((named[a], named[b])))] = s
        assert got == want and len(want) > 8


@pytest.mark.parametrize("seed", [1, 2])
def test_structural_dedup_equals_the_pass_in_order(spark, seed):
    texts, zoo = expressions(150, seed), ["Rank(Mean(close, 5))", "Corr(close, open, 3)", "not one ("]
    rows = [(k, t if t else None, "x") for k, t in enumerate(texts)]
    got = T.structural_dedup(spark.createDataFrame(rows, "place long, expr string, class string").repartition(3), spark.createDataFrame([(z,) for z in zoo], "expr string"))
    want = pool.structural_dedup([(k, t or "(") for k, t, _ in rows], [z for z in zoo if z[-1] != "("])
    assert sorted(r["place"] for r in got.collect()) == [k for k, _ in want]
    assert set(got.columns) == {"place", "expr", "class"}


def test_structural_dedup_of_nothing(spark):
    none = spark.createDataFrame([], "place long, expr string")
    assert T.structural_dedup(none, none.select("expr")).count() == 0
    one = spark.createDataFrame([(1, None), (2, "Rank("), (3, None)], "place long, expr string")
    assert T.structural_dedup(one, none.select("expr")).count() == 3


def test_described(spark):
    got = {r["expr"]: r for r in T.described(spark.createDataFrame([("Rank($Close)",), ("Rank(",), ("Foo(open, 3)",), (None,)], "expr string")).collect()}
    assert len(got) == 3 and got["Rank($Close)"]["hash"] == X.expr_hash("Rank(close)") and got["Rank($Close)"]["valid"]
    assert got["Rank("]["canonical"] is None and not got["Rank("]["valid"] and not got["Foo(open, 3)"]["valid"] and got["Foo(open, 3)"]["sl"] == 4


def test_columns_of_new_windows(spark):
    rng = np.random.default_rng(7)
    rows = [(DAY + datetime.timedelta(days=i), a, None if (a, i) == ("b", 7) else float(v)) for a in "abc" for i, v in enumerate(rng.normal(10, 2, 40))]
    df = spark.createDataFrame(rows, "trade_date date, ts_code string, close double")
    got = df.select("trade_date", "ts_code", X.compiled("Median(close, 5)").alias("median"), X.compiled("EMA(close, 3)").alias("ema"), X.compiled("EMA(close, 1)").alias("one"), X.compiled("CSZScore(close)").alias("z")).toPandas().sort_values(["ts_code", "trade_date"])
    want = pd.DataFrame(rows, columns=["trade_date", "ts_code", "close"])
    by = want.groupby("ts_code")["close"]
    want["median"] = by.transform(lambda x: x.rolling(5).median())
    want["ema"] = by.transform(lambda x: x.ewm(span=3, adjust=False, ignore_na=True).mean().where(x.notna()))
    day = want.groupby("trade_date")["close"]
    want["z"] = (want["close"] - day.transform("mean")) / day.transform("std")
    for c, w in (("median", "median"), ("ema", "ema"), ("one", "close"), ("z", "z")):
        assert np.allclose(got[c].astype(float), want[w].astype(float), equal_nan=True), c


# --- groups, totals, chains ---------------------------------------------------------------------------


def test_groups_and_running_totals(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (8, 1), (20, 21)] + [(k, k + 1) for k in range(100, 160)]
    got = {r["node"]: r["group"] for r in groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 5: 5, 20: 20, 21: 20} | dict.fromkeys(range(100, 161), 100)
    assert groups(spark.createDataFrame([], "a long, b long")).count() == 0
    rows = spark.range(500).selectExpr("id * 7 % 500 AS k").repartition(7)
    total = running_total(rows, "k", F.col("k") % 3 == 0, "n").collect()
    assert len(total) == 500 and all(r["n"] == r["k"] // 3 + 1 for r in total)


def chains_by_brute_force(records, series, least=0.7):
    """The store gone through in order, with Pearson over the common dates of ten days and more."""
    found, out = [], []
    for seq, name, rank_ic in records:
        best = None
        for c, chain in enumerate(found):
            for p, (member, _) in enumerate(chain):
                a, b = series.get(name, {}), series.get(member, {})
                days = sorted(set(a) & set(b))
                if len(days) < 10:
                    continue
                x, y = np.array([a[d] for d in days]), np.array([b[d] for d in days])
                if x.std() <= 0 or y.std() <= 0:
                    continue
                corr = abs(np.corrcoef(x, y)[0, 1])
                if corr >= least and (best is None or corr > best[0] + 1e-12):
                    best = corr, c, p
        if best is None:
            found.append([(name, rank_ic)])
            out.append((seq, "new_chain", len(found) - 1, 0, None, len(found)))
        elif rank_ic is not None and all(rank_ic > (r or -math.inf) for _, r in found[best[1]]):
            found[best[1]].append((name, rank_ic))
            out.append((seq, "extend", best[1], len(found[best[1]]) - 1, best[2], len(found)))
        else:
            out.append((seq, "reject_not_beating_chain", best[1], None, best[2], len(found)))
    return out


def test_chains(spark):
    rng = np.random.default_rng(8)
    bases = rng.normal(0, 1, (4, 30))
    series, recs = {}, []
    for k in range(40):
        r = bases[k % 4] + rng.normal(0, 0.6, 30) if k % 9 else rng.normal(0, 1, 30)
        series[f"r{k}"] = {i: float(v) for i, v in enumerate(r) if k != 11 or i < 9}
        recs.append((k * 3, f"r{k}", None if k % 13 == 5 else 0.0 if k % 10 == 4 else float(rng.normal(0, 0.05))))
    recs.append((200, "no series", 0.1))
    rows = spark.createDataFrame([(n, DAY + datetime.timedelta(days=i), v) for n, s in series.items() for i, v in s.items()], "series_id string, d date, r double")
    records_df = spark.createDataFrame(recs, "seq long, record_id string, rank_ic double").repartition(3)
    got = chains.chain_updates(records_df, rows)
    want = chains_by_brute_force(recs, series)
    assert sorted((r["seq"], r["action"], r["chain"], r["position"], r["best_member_position"], r["n_chains"]) for r in got.collect()) == want
    assert {a for _, a, *_ in want} == {"new_chain", "extend", "reject_not_beating_chain"}
    table = {r["chain"]: r["length"] for r in chains.chains_of(got).collect()}
    assert sum(table.values()) == sum(a != "reject_not_beating_chain" for _, a, *_ in want) and len(table) == want[-1][-1]


# --- jobs ---------------------------------------------------------------------------------------------


class Store:
    """One desk's table of jobs, each op done on it at once."""

    def __init__(self):
        self.rows = {}

    def active(self):
        return [(k, r) for k, r in self.rows.items() if r["status"] in ("running", "queued")]

    def do(self, op, job, kind, key, status, error, most):
        row, reason, other = self.rows.get(job), None, None
        if op == "start":
            same = [k for k, r in self.active() if r["kind"] == kind and (key is None or r["key"] == key)]
            if same:
                reason, other = "duplicate_pending", same[-1]
            elif len(self.active()) >= most:
                reason = "max_jobs_reached"
            else:
                self.rows[job] = {"kind": kind, "key": key, "status": "running", "error": None}
        elif op in ("submit", "run"):
            self.rows[job] = {"error": row["error"] if row else None, "kind": kind, "key": key, "status": "queued" if op == "submit" else "running"}
        elif op == "finish":
            if row:
                row |= {"status": status, "error": error}
        elif op == "exit":
            if row and row["status"] == "running":
                row |= {"status": "error", "error": "child_exited"}
            else:
                reason = "not_running"
        elif op == "cancel":
            if row is None:
                reason = f"unknown job {job}"
            elif row["status"] not in ("running", "queued"):
                reason = f"job not cancellable: {row['status']}"
            else:
                row["status"] = "cancelled"
        elif op == "delete":
            self.rows.pop(job, None)
        else:
            reason = "unknown_op"
        row = self.rows.get(job)
        return reason is None, reason, other, len(self.active()), row["status"] if row else None, row["error"] if row else None


def job_rows(n=900):
    rng = random.Random(6)
    rows, last = [], {}
    for seq in range(n):
        desk = rng.choice(["a", "a", "a", "b", "c"])
        op = rng.choice([*jobs.OPS, "start", "start", "finish", "nonsense"] if seq % 50 == 7 else [*jobs.OPS, "start", "start", "finish"])
        job = f"j{seq}" if op in ("start", "submit", "run") and rng.random() < 0.9 else rng.choice(last.get(desk, ["j?"])[-4:] + ["j?"])
        if op in ("start", "submit", "run"):
            last.setdefault(desk, []).append(job)
        rows.append((desk, seq, op, job, rng.choice("xy"), rng.choice([None, "k1", "k2"]), rng.choice(["done", "error"]), rng.choice([None, "went wrong"])))
    return rows


OPS = "desk string, seq long, op string, job_id string, kind string, dedup_key string, status string, error string"


def test_jobs(spark):
    rows = [r for r in job_rows() if not (r[2] in ("start", "submit", "run") and r[3] == "j?")]
    # An id that is asked for again while its row is there is taken over by submit and run; a start always has a new one.
    rows = [(d, s, "run" if op == "start" and j != f"j{s}" else op, j, *rest) for d, s, op, j, *rest in rows]
    done = jobs.decisions(spark.createDataFrame([*rows, (None, 5000, "start", "j", "x", None, None, None)], OPS).repartition(3))
    stores, want = {}, {}
    for desk, seq, op, job, kind, key, status, error in rows:
        want[seq] = stores.setdefault(desk, Store()).do(op, job, kind, key, status, error, jobs.MOST_JOBS)
    got = {r["seq"]: (r["ok"], r["reason"], r["other_id"], r["n_active"], r["status"], r["error"]) for r in done.collect()}
    assert got == want
    assert {w[1] for w in want.values() if w[1]} >= {"duplicate_pending", "max_jobs_reached", "not_running", "job not cancellable: done", "unknown job j?"}
    table = {(r["desk"], r["job_id"]): (r["kind"], r["status"], r["error"]) for r in jobs.jobs(done).collect()}
    assert table == {(d, j): (r["kind"], r["status"], r["error"]) for d, s in stores.items() for j, r in s.rows.items()}


def test_jobs_as_a_stream(spark, tmp_path):
    rows = job_rows(300)
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], OPS).coalesce(1).write.mode("append").parquet(source)
    ops = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(source)
    # Files of one run may come in any order of names; the ops of a batch are in order within it.
    out = job_stream.decisions(ops).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert out.awaitTermination(120)
    got = {r["seq"]: (r["ok"], r["reason"], r["other_id"], r["n_active"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {r["seq"]: (r["ok"], r["reason"], r["other_id"], r["n_active"]) for b in jobs._folded(jobs.MOST_JOBS)(iter([pd.DataFrame(sorted(rows), columns=jobs.COLUMNS)])) for r in b.astype(object).where(b.notna(), None).to_dict("records")}
    assert got == whole


# --- sweeps, error keys, lint -------------------------------------------------------------------------


def test_a_sweep_survives_bad_candidates(spark, sf_dir):
    from quantloom.sources import panel as P

    p = P.brand_panel(spark, sf_dir)
    good = [("mom", "close", 5), ("rev", "high", 3)]
    out = {r["factor"]: r for r in E.sweep(p, [*good, ("mom", "nothing", 5), ("x", "close", 5), ("rev", "close", -1), ("rev", "trade_date", 2), good[0]]).collect()}
    assert len(out) == 6 and [out[k]["ok"] for k in ("mom_close_5", "rev_high_3")] == [True, True] and out["mom_close_5"]["days"] > 0
    assert all(out[k]["error"] and not out[k]["ok"] and out[k]["days"] == 0 for k in ("mom_nothing_5", "x_close_5", "rev_close_-1", "rev_trade_date_2"))
    assert E.sweep(p, [("x", "close", 5)]).count() == 1


def test_error_keys_of_any_length(spark):
    long = ["e" * 20_000 + str(k) for k in range(50)] + ["e" * 20_000, "e" * 7, "", "E" * 20_001 + ": more"]
    members, kin = records.error_kin(spark.createDataFrame([(x,) for x in long], "e string"))
    keys = {r["key"] for r in members.collect()}
    got = {(r["key"], r["longer"]) for r in kin.collect()}
    assert got == {(a, b) for a in keys for b in keys if b.startswith(a)} and len(got) > 150


def test_wiki_issues(spark):
    now = datetime.datetime(2024, 6, 30)
    rows = [("a", "t", "---\nx", now), ("b", "", "x", now - datetime.timedelta(days=91)), ("c", None, None, None)]
    got = records.wiki_issues(spark.createDataFrame(rows, "slug string, title string, text string, updated timestamp"), F.lit(now)).collect()
    assert sorted(map(tuple, got)) == [(s, i) for s in "bc" for i in ("missing_frontmatter", "missing_title", "stale")]


def test_correlations_with_some(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{k}", DAY + datetime.timedelta(days=i), float(v)) for k in range(6) for i, v in enumerate(rng.normal(0, 1, 20 if k else 5))]
    df = spark.createDataFrame(rows, "series_id string, d date, r double")
    got = {(r["a"], r["b"]): r["corr"] for r in S.correlations_with(df, ["s1", "s2"]).collect()}
    for a in ("s1", "s2"):
        one = {r["b"]: r["corr"] for r in S.correlation_with(df, a).collect()}
        assert {b: c for (x, b), c in got.items() if x == a} == pytest.approx(one)


# --- SQLite, syncs, cached results --------------------------------------------------------------------


@pytest.fixture
def catalog(spark, tmp_path):
    rows = [(k, f"name {k}%_" if k % 3 else None, k / 4, ["red", "Red", "blue"][k % 3], bytes([k % 256])) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, name string, value double, style string, raw binary").repartition(3)
    sqlite.write(df, f"file://{tmp_path}/db", "it", ["style"])
    return df, str(tmp_path / "db")


def test_sqlite_round_trip(spark, catalog):
    df, folder = catalog
    assert len([f for f in os.listdir(folder)]) == 3
    back = sqlite.read(spark, folder, "it", rows=100)
    assert back.dtypes == [("id", "bigint"), ("name", "string"), ("value", "double"), ("style", "string"), ("raw", "binary")]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()), key=lambda r: r[0]) and back.rdd.getNumPartitions() > 3
    with pytest.raises(sqlite3.OperationalError), sqlite.opened(os.path.join(folder, os.listdir(folder)[0])) as c:
        c.execute("DELETE FROM it")


FILTERS = ["style = 'red'", "style IN ('red', 'blue') AND id < 50", "name LIKE 'name 1%'", "name LIKE '%7\\\\%\\\\_'", "name LIKE '%99%'", "name IS NULL AND id >= 900", "NOT style = 'red' AND name IS NOT NULL", "value > 100.5", "id <= 3 OR style = 'Red'", "id + 1 = 7", "lower(style) = 'red' AND id > 990"]


@pytest.mark.parametrize("test", FILTERS)
def test_sqlite_filters(spark, catalog, test):
    df, folder = catalog
    got = sqlite.read(spark, folder, "it").where(test)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in df.where(test).collect())


def test_sqlite_takes_filters_over():
    r = sqlite.Reader(None, {"path": "x", "table": "it"})
    kept = list(r.pushFilters([D.EqualTo(("style",), "red"), D.GreaterThan(("id",), 5), D.EqualTo(("value",), 1.5), D.StringStartsWith(("name",), "a"), D.Not(D.EqualTo(("id",), 3)), D.Not(D.IsNull(("id",))), D.In(("id",), (1, 2)), D.EqualTo(("a", "b"), 1)]))
    assert kept == [D.EqualTo(("value",), 1.5), D.Not(D.IsNull(("id",))), D.EqualTo(("a", "b"), 1)]
    r.schema = type("S", (), {"names": ["id"]})
    sql, values = r.statement(sqlite.Range("f", 1, 9))
    assert sql.count("?") == len(values) == 9 and '"style" = ?' in sql and "rowid BETWEEN" in sql


def test_sqlite_without_rowid_and_empty(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as c:
        c.execute("CREATE TABLE w (k TEXT PRIMARY KEY, n INT) WITHOUT ROWID")
        c.execute("INSERT INTO w VALUES ('a', 1), ('b', NULL)")
        c.execute("CREATE TABLE none (k TEXT)")
    assert sorted(map(tuple, sqlite.read(spark, str(tmp_path / "x.db"), "w").collect())) == [("a", 1), ("b", None)]
    assert sqlite.read(spark, str(tmp_path / "x.db"), "none").count() == 0


def year_panel(spark, year, n=30, add=0.0):
    rows = [(datetime.date(year, 1, 1) + datetime.timedelta(days=k), f"s{k % 3}", *(float(k) + add,) * 6) for k in range(n)]
    return spark.createDataFrame(rows, "trade_date date, ts_code string, open double, high double, low double, close double, volume double, amount double")


def test_years_are_synced_one_by_one(spark, tmp_path):
    root = f"file://{tmp_path}/panel"
    first = sync.sync_years(spark, root, [2020, 2021], lambda y: year_panel(spark, y))
    assert {f["year"] for f in first["files"]} == {2020, 2021} and not first["errors"]

    def broken(year):
        if year == 2021:
            raise OSError("the vendor is down")
        return year_panel(spark, year, add=100.0) if year == 2020 else year_panel(spark, year, n=0) if year == 2023 else year_panel(spark, year)

    after = sync.sync_years(spark, root, [2020, 2021, 2022, 2023], broken)
    assert set(after["errors"]) == {"2021", "2023"} and "vendor" in after["errors"]["2021"]
    got = sync.read_synced(spark, root, 2020, 2022).groupBy(F.year("trade_date").alias("y")).agg(F.min("close").alias("low")).collect()
    assert sorted(map(tuple, got)) == [(2020, 100.0), (2021, 0.0), (2022, 0.0)]
    with pytest.raises(FileNotFoundError, match="2023"):
        sync.read_synced(spark, root, 2020, 2023)
    again = sync.sync_years(spark, root, [2021], lambda y: year_panel(spark, y))
    assert set(again["errors"]) == {"2023"}
    gone = sync.vacuum(spark, root)
    assert gone and sync.read_synced(spark, root, 2020, 2022).count() == 90 and not sync.vacuum(spark, root)


@pytest.mark.parametrize("step", ["write", "digest", "manifest"])
def test_a_broken_sync_loses_nothing(spark, tmp_path, monkeypatch, step):
    root = f"file://{tmp_path}/panel"
    before = sync.sync_years(spark, root, [2020], lambda y: year_panel(spark, y))

    def stop(*args, **kw):
        raise KeyboardInterrupt

    if step == "manifest":
        monkeypatch.setattr(sync, "write_json", stop)
    if step == "digest":
        monkeypatch.setattr(sync, "_digests", stop)
    with pytest.raises(KeyboardInterrupt):
        sync.sync_years(spark, root, [2020], stop if step == "write" else lambda y: year_panel(spark, y, add=5.0))
    monkeypatch.undo()
    assert sync.manifest(spark, root) == before and sync.read_synced(spark, root, 2020, 2020).agg(F.min("close")).first()[0] == 0.0


def test_a_changed_file_is_noticed(spark, tmp_path):
    root = f"file://{tmp_path}/panel"
    m = sync.sync_years(spark, root, [2020], lambda y: year_panel(spark, y))
    name = m["files"][0]["name"]
    year_panel(spark, 2020, add=1.0).coalesce(1).write.parquet(f"{root}/other")
    other = next(f for f in os.listdir(tmp_path / "panel/other") if f.endswith(".parquet"))
    os.replace(tmp_path / "panel/other" / other, tmp_path / "panel/data" / name)
    os.remove((tmp_path / "panel/data" / name).parent / f".{name.rsplit('/', 1)[1]}.crc")  # else the local file system notices first
    with pytest.raises(ValueError, match="differs from the manifest"):
        sync.read_synced(spark, root, 2020, 2020).count()


def test_results_are_kept_until_their_inputs_change(spark, tmp_path):
    source, root = f"file://{tmp_path}/in", f"file://{tmp_path}/kept"
    spark.range(5).write.parquet(source)
    built = []

    def ask(**parameters):
        def build():
            built.append(parameters)
            return spark.read.parquet(source).agg(F.count("*").alias("n"))

        out, known = cache.cached(spark, "count", parameters, [source], build, root)
        return out.first()["n"], known

    assert ask(a=1, b=2) == (5, False) and ask(b=2, a=1) == (5, True) and ask(a=2, b=2) == (5, False) and len(built) == 2
    spark.range(3).write.mode("append").parquet(source)
    assert ask(a=1, b=2) == (8, False) and ask(a=1, b=2) == (8, True) and len(built) == 3
    assert len(os.listdir(next(p for p in (tmp_path / "kept/count").iterdir() if len(os.listdir(p)) == 1))) == 1
    with pytest.raises(FileNotFoundError):
        cache.cached(spark, "count", {}, [f"{source}-not"], lambda: None, root)


def test_a_result_that_broke_off_does_not_count(spark, tmp_path):
    source, root = f"file://{tmp_path}/in", f"file://{tmp_path}/kept"
    spark.range(5).write.parquet(source)
    with pytest.raises(Exception, match="(?i)zero|divi"):
        cache.cached(spark, "x", {}, [source], lambda: spark.range(4).select(F.expr("raise_error('divided by zero')").alias("e")), root)
    assert cache.cached(spark, "x", {}, [source], lambda: spark.range(4), root)[1] is False


# --- user code ----------------------------------------------------------------------------------------

CODE = """
NAME = "mine"
EXPRESSION = "Rank(close)"
def compute(panel):
    asset = panel["ts_code"][0]
    if asset == "loops":
        while True:
            pass
    if asset == "grows":
        x = [0] * 10
        while True:
            x = x + x
    if asset == "raises":
        return [1 / 0]
    if asset == "short":
        return [1.0]
    if asset == "words":
        return {"a": "b"}
    if asset == "dict":
        return {k: v for k, v in enumerate(panel["close"])}
    return [v * 2 for v in panel["close"]]
"""


def test_user_code_with_limits(spark):
    assets = ["fine", "loops", "grows", "raises", "short", "words", "dict"]
    rows = [(DAY + datetime.timedelta(days=k), a, float(k)) for a in assets for k in range(4)]
    df = spark.createDataFrame(rows, "trade_date date, ts_code string, close double")
    got = user_code.apply_isolated(df, CODE, seconds=3, megabytes=200).toPandas()
    errors = dict(got[got.error.notna()][["ts_code", "error"]].values)
    assert errors["loops"].startswith("timeout") and errors["grows"].startswith("memory") and errors["raises"] == "ZeroDivisionError: division by zero"
    assert errors["short"] == "compute returned 1 values for 4 bars" and errors["words"] == "compute_dict_not_numeric" and len(errors) == 5
    assert list(got[got.ts_code == "fine"].score) == [0, 2, 4, 6] and list(got[got.ts_code == "dict"].score) == [0, 1, 2, 3]
    assert user_code.constants(CODE) == {"NAME": "mine", "EXPRESSION": "Rank(close)"}

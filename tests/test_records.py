import datetime
import random

import pytest
from pyspark.sql import functions as F

from quantloom import session
from quantloom.operators import gates, pool
from quantloom.operators import records as C
from quantloom.streaming import bars


def test_upsert_keeps_id_and_creation(spark):
    kinds = "source string, source_ref int, id int, created_at int, updated_at int, name string"
    old, new = spark.createDataFrame([("s", 1, 10, 1, 1, "a"), ("s", 2, 11, 1, 1, "b")], kinds), spark.createDataFrame([("s", 1, 99, 5, 5, "c"), ("s", 3, 12, 5, 5, "d")], kinds)
    got = {r["source_ref"]: (r["id"], r["created_at"], r["name"]) for r in C.upserted(old, new).collect()}
    assert got == {1: (10, 1, "c"), 2: (11, 1, "b"), 3: (12, 5, "d")}


def test_clamped_weights(spark):
    log = spark.createDataFrame([("m", k, k != 3) for k in range(4)] + [("n", k, True) for k in range(9)] + [("n", 9, False)], "signature string, seq int, survived boolean")
    got = {r["signature"]: tuple(r)[1:] for r in C.clamped_weights(log).collect()}
    assert got == {"m": (5.0, 4, 3), "n": (9.0, 10, 9)}


def test_clamped_weights_fold_in_stretches(spark, monkeypatch):
    random.seed(1)
    steps = [random.random() < 0.4 for _ in range(200)]
    want = 0.0
    for s in steps:
        want = max(-10.0, min(10.0, want + (2.0 if s else -1.0)))
    monkeypatch.setattr(C, "FOLD_ROWS", 7)
    log = spark.createDataFrame([("m", k, s) for k, s in enumerate(steps)], "signature string, seq int, survived boolean")
    assert C.clamped_weights(log).first()["weight"] == want


def test_paging_clamps(spark):
    rows, total, more = C.page(spark.range(5), ["id"], -3, 0)
    assert (rows.count(), total, more) == (1, 5, 1)
    assert C.page(spark.range(5), ["id"], 4, 500)[2] is None


def test_search_escapes_wildcards(spark):
    c = spark.createDataFrame([(1, "a%b", 1), (2, "aXb", 2)], "id int, name string, updated_at int")
    assert [r["id"] for r in C.search(c, "A%B").collect()] == [1]


def test_gates(spark):
    base = {"simulated": F.lit(False), "formula_proxy": F.lit(False), "n_assets": F.lit(50), "n_days": F.lit(60), "ic": F.lit(0.006), "n_returns": F.lit(100), "pool_corr": F.lit(0.7), "library_corr": F.lit(0.9), "corr_error": F.lit(None).cast("string"), "code": F.lit("x"), "ic_ir": F.lit(0.5), "dsr": F.lit(None).cast("double"), "similarity": F.lit(0.0), "sl": F.lit(1), "pc": F.lit(1), "fc": F.lit(1)}
    one = lambda direction, override=frozenset(), **k: spark.range(1).select(gates.failures(base | k, direction, override)).first()[0]
    assert one("to_pool") == []
    assert one("to_pool", ic=F.lit(0.005)) == ["ic_threshold"]
    assert one("to_library", ic=F.lit(0.005), library_corr=F.lit(0.2)) == [] and one("to_library") == ["correlated"]
    assert one("to_pool", n_days=F.lit(59)) == one("to_pool", n_assets=F.lit(19)) == one("to_pool", n_assets=F.lit(None).cast("int")) == ["thin_panel"]
    assert one("to_pool", pool_corr=F.lit(0.71)) == ["correlated"] and one("to_pool", corr_error=F.lit("locked")) == ["corr_error:locked"]
    assert one("to_pool", n_returns=F.lit(0), pool_corr=F.lit(0.9)) == ["missing_returns"]
    assert one("to_pool", ic=F.lit("nan")) == ["missing_ic"]
    assert one("to_pool", ic_ir=F.lit(0.1)) == ["weak_ic"]
    assert one("to_pool", frozenset({"weak_ic", "simulated"}), ic_ir=F.lit(0.1), simulated=F.lit(True)) == ["simulated"]


def test_greedy_selection(spark):
    day = datetime.date(2024, 1, 1)
    series = {"a": [0.01 * k for k in range(14)], "b": [0.02 * k for k in range(14)], "c": [(-1) ** k * 0.01 for k in range(14)]}
    s = spark.createDataFrame([(n, day + datetime.timedelta(k), r) for n, v in series.items() for k, r in enumerate(v)], "series_id string, d date, r double")
    f = spark.createDataFrame([("a", 0.05, 3.0), ("b", 0.04, 2.0), ("c", 0.03, 1.0), ("d", 0.005, 9.0)], "name string, ic double, score double").withColumns({"profile": F.lit("m"), "simulated": F.lit(False), "status": F.lit("review")})
    assert pool.pool_cull(f, s) == ["a", "c"]
    assert pool.diverse_samples(f, s, 3) == ["a", "c", "b"]
    corr = pool.correlations(s)
    assert pool.chain_decision(("b", 0.2), [[("a", 0.1)]], corr) == ("extend", 0)
    assert pool.chain_decision(("b", 0.05), [[("a", 0.1)]], corr) == ("reject", 0)
    assert pool.chain_decision(("c", 0.05), [[("a", 0.1)]], corr) == ("new", 1)


def test_structural_dedup():
    kept = pool.structural_dedup([("a", "Rank(Delta(close, 20))"), ("b", "Rank(volume)"), ("c", "Rank(volume)"), ("d", "(")], ["Rank(Delta(close, 20))"])
    assert [k for k, _ in kept] == ["b", "d"]


def test_stream_makes_bars(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, d, h), "view", float(10 * d + h)) for d in (1, 2, 4) for h in (1, 5)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = bars.bars(events).writeStream.format("memory").queryName("made_bars").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r["trade_date"].day: (r["open"], r["close"], r["volume"]) for r in spark.table("made_bars").collect()}
    assert got == {1: (11.0, 15.0, 2.0), 2: (21.0, 25.0, 2.0)}


def test_error_pairs_of_short_keys(spark):
    errors = ["io: x", "IO : y", "io error: z", ": w", "i", "disk: full", "disk", "iota"]
    key = lambda e: e.split(":")[0].strip().lower()
    want = {(a, b) for a in errors for b in errors if a < b and (key(a).startswith(key(b)) or key(b).startswith(key(a)))}
    df = spark.createDataFrame([(e,) for e in [*errors, *errors, None]], "e string")
    got = [tuple(r) for r in C.error_pairs(df).collect()]
    assert len(got) == len(want) and set(got) == want
    kin = C.error_kin(df)[1]
    assert {tuple(r) for r in kin.where("longer = 'io error'").collect()} == {("", "io error"), ("i", "io error"), ("io", "io error"), ("io error", "io error")}


def test_scratch_needs_a_shared_folder_off_a_local_master():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        session.scratch(Session())


def test_settings_hold_until_the_last_save_has_ended(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with session.settings_while_saved(spark):
        with session.settings_while_saved(spark):
            pass
        assert spark.conf.get(key) == "8m"
    assert spark.conf.get(key) == before


def test_redaction_at_any_depth(spark):
    rows = ['{"a": {"TOKEN": "x\\"}y", "b": [1, {"secret": [1, 2]}]}, "c": null}', "not json", None, "[]", '"token"', '{"token": {"deep": 1}}']
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").orderBy("k").select(C.redacted_json(F.col("t"))).collect()]
    assert got == ['{"a":{"TOKEN":"***","b":[1,{"secret":"***"}]},"c":null}', "not json", None, "[]", '"token"', '{"token":"***"}']


def test_correlations_in_blocks(spark, monkeypatch):
    from quantloom.operators import series as S

    monkeypatch.setattr(S, "BLOCK", 7)
    random.seed(1)
    day = datetime.date(2024, 1, 1)
    values = {f"s{k:02}": {t: random.gauss(5, 1) for t in random.sample(range(40), random.randint(3, 40))} for k in range(30)} | {"flat": dict.fromkeys(range(40), 2.0)}
    s = spark.createDataFrame([(n, day + datetime.timedelta(t), r) for n, v in values.items() for t, r in v.items()], "series_id string, d date, r double")
    got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in S.pairwise(s).collect()}
    names = sorted(values)
    for i, a in enumerate(names):
        with_a = {r["b"]: r["corr"] for r in S.correlation_with(s, a).collect()} if i in (0, 5) else None
        for b in names[i + 1 :]:
            common = sorted(values[a].keys() & values[b].keys())
            x, y = [values[a][t] for t in common], [values[b][t] for t in common]
            if not common:
                assert (a, b) not in got
                continue
            mx, my = sum(x) / len(x), sum(y) / len(y)
            sxy, sxx, syy = sum((p - mx) * (q - my) for p, q in zip(x, y)), sum((p - mx) ** 2 for p in x), sum((q - my) ** 2 for q in y)
            n, c = got[a, b]
            fine = len(common) >= 10 and "flat" not in (a, b)
            assert n == len(common) and (c is None) == (not fine) and (not fine or abs(c - sxy / (sxx * syy) ** 0.5) < 1e-9)
            assert with_a is None or (with_a[b] is None) == (c is None) and (c is None or abs(with_a[b] - c) < 1e-9)


def test_pool_of_many_factors(spark):
    """Against the plain greedy pass over all pairs."""
    random.seed(2)
    day = datetime.date(2024, 1, 1)
    kinds = [[random.gauss(0, 1) for _ in range(30)] for _ in range(9)]
    values = {f"f{k:03}": [x + random.gauss(0, 0.4) for x in kinds[k % 9]] for k in range(150)}
    s = spark.createDataFrame([(n, day + datetime.timedelta(t), r) for n, v in values.items() for t, r in enumerate(v)], "series_id string, d date, r double")
    rows = [(n, random.choice([-1, 1]) * 0.02, float(random.randint(0, 40)), random.choice("xy"), k % 31 == 0, "culled" if k % 7 == 0 else "review") for k, n in enumerate(values)]
    factors = spark.createDataFrame(rows, "name string, ic double, score double, profile string, simulated boolean, status string")
    corr = pool.correlations(s)
    kept = []
    for n, ic, _, profile, simulated, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        sign = 1 if ic >= 0 else -1
        if not simulated and all(corr(n, m) * sign * t <= 0.7 for m, t, p in kept if p == profile):
            kept.append((n, sign, profile))
    assert pool.pool_cull(factors, s) == [n for n, *_ in kept]
    names = [n for n, ic, *_, status in sorted(rows, key=lambda r: (-abs(r[1]), r[0])) if status == "review"]
    chosen = names[:1]
    while len(chosen) < 6:
        chosen.append(min((n for n in names if n not in chosen), key=lambda n: (max(abs(corr(n, c)) for c in chosen), names.index(n))))
    assert pool.diverse_samples(factors, s, 6) == chosen


def test_combine_ready(spark):
    from quantloom.operators import series as S

    day = datetime.date(2024, 1, 1)
    s = spark.createDataFrame([(n, day + datetime.timedelta(t), 0.01 * ((t * k) % 5 - 2)) for k, n in enumerate(["a", "b", "c"], 1) for t in range(40)], "series_id string, d date, r double")
    catalog = spark.createDataFrame([("a", "ready", 1), ("b", "ready", 2), ("c", "review", 3), ("z", "ready", 4)], "id string, status string, updated_at int")
    assert S.combine_ready(catalog.where("id <> 'a'"), s) == "insufficient_ready_factors"
    assert S.combine_ready(catalog, s).count() == 40


def test_normal_distribution(spark):
    from statistics import NormalDist

    from quantloom.operators import series as S

    xs = [-40.0, -8.5, -7.1, -3.0, -0.5, 0.0, 1e-9, 0.7, 2.5, 7.2, 39.0]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").orderBy("k").select(S.normal_cdf(F.col("x"))).collect()]
    assert all(abs(g - NormalDist().cdf(x)) < 1e-13 for g, x in zip(got, xs))

import datetime
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quantloom.operators import evaluation as E
from quantloom.operators import scores, user_code
from quantloom.operators import series as S
from quantloom.sources import panel as P

DAY = datetime.date(2024, 1, 1)


def aligned(spark, days=20, assets=25, fwd=lambda d, i: 0.001 * ((i % 5) - 2)):
    rows = [("f", DAY + datetime.timedelta(d), f"{i:02d}", i + 0.01 * d, fwd(d, i)) for d in range(days) for i in range(assets)]
    return spark.createDataFrame(rows, "factor string, trade_date date, ts_code string, score double, fwd double")


def test_ic_is_correlation_shrunk_by_sample_deviations(spark):
    r = E.daily_ic(aligned(spark)).first()
    x, y = list(range(25)), [0.001 * ((i % 5) - 2) for i in range(25)]
    assert r["ic"] == pytest.approx(statistics.correlation(x, y) * 24 / 25)
    assert r["n"] == 25


def test_ic_needs_members_and_spread(spark):
    assert E.daily_ic(aligned(spark, assets=9)).where("ic IS NOT NULL").isEmpty()
    assert E.daily_ic(aligned(spark, fwd=lambda d, i: 0.1)).where("ic IS NOT NULL").isEmpty()


def test_long_leg_is_the_lowest_bucket(spark):
    r = E.long_short(aligned(spark, 2, 20, lambda d, i: float(i))).orderBy("trade_date").collect()
    assert r[0]["ls"] == pytest.approx(1.5 - 17.5)
    assert r[0]["turnover"] is None and r[1]["turnover"] == 0.0
    assert E.long_short(aligned(spark, 2, 20, lambda d, i: float(i)), direction=-1).first()["ls"] == pytest.approx(16.0)


def test_thin_day_resets_turnover(spark):
    rows = aligned(spark, 4).where(~((F.col("trade_date") == DAY + datetime.timedelta(1)) & (F.col("ts_code") >= "10")))
    got = [(r["trade_date"].day, r["turnover"]) for r in E.long_short(rows).orderBy("trade_date").collect()]
    assert got == [(1, None), (3, None), (4, 0.0)]


def test_point_in_time_universe(spark):
    snapshots = spark.createDataFrame([(DAY + datetime.timedelta(1), "a"), (DAY + datetime.timedelta(3), "b")], "asof date, ts_code string")
    rows = spark.createDataFrame([(DAY + datetime.timedelta(d), c) for d in range(5) for c in "ab"], "trade_date date, ts_code string")
    got = sorted((r["trade_date"].day, r["ts_code"]) for r in E.point_in_time(rows, snapshots).collect())
    assert got == [(2, "a"), (3, "a"), (4, "b"), (5, "b")]


def test_embargo(spark):
    days = spark.createDataFrame([(DAY + datetime.timedelta(d),) for d in range(5)], "trade_date date")
    assert E.scoped(days, "2024-01-01", "2024-01-03").count() == 2
    assert E.scoped(days, "2024-01-01", "2024-01-01").count() == 1


def test_rebalance_dates(spark):
    got = sorted(str(r[0]) for r in E.rebalance_dates(spark, "2024-01-01", "2024-12-31").collect())
    assert got == ["2024-06-14", "2024-12-13"]


def test_sweep_has_all_candidates_and_prefix_ranking(spark):
    assert len(scores.sweep_grid()) == 145
    t = spark.createDataFrame([("a", "IS", 1.0), ("b", "IS", 2.0), ("c", "OOS", 3.0), ("d", "IS", None)], "factor string, window string, ic double")
    assert [r["factor"] for r in E.top_k(t, "is_ic", 2).collect()] == ["b", "a"]


def test_neutralised_scores_are_orthogonal_also_for_collinear_controls(spark):
    random.seed(3)
    rows = [(DAY, str(i), random.random(), x := random.random(), 2 * x, random.random()) for i in range(30)]
    df = spark.createDataFrame(rows, "trade_date date, ts_code string, score double, a double, b double, c double")
    for controls in (["a"], ["a", "b"], ["a", "c"], ["a", "b", "c"]):
        got = scores.neutralised(df, controls).join(df.drop("score"), ["trade_date", "ts_code"])
        for c in controls:
            assert abs(got.select(F.covar_pop("score", c)).first()[0]) < 1e-9
        assert abs(got.select(F.sum("score")).first()[0]) < 1e-9


def long_series(spark, **series):
    rows = [(k, DAY + datetime.timedelta(d), float(v)) for k, vs in series.items() for d, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, d date, r double")


def test_return_math(spark):
    s = long_series(spark, up=[0.01] * 25, mixed=[0.02, -0.01] * 12, few=[0.01, 0.02])
    got = {r["series_id"]: r["sharpe"] for r in S.sharpe(s).collect()}
    assert got["few"] is None and got["up"] is None
    assert got["mixed"] == pytest.approx(0.005 * math.sqrt(252) / 0.015)
    falls = {r["series_id"]: r["max_drawdown"] for r in S.max_drawdown(s).collect()}
    assert falls["up"] == 0 and falls["mixed"] == pytest.approx(-0.01)


def test_deflated_sharpe_falls_with_trials(spark):
    s = long_series(spark, a=[0.01] * 24 + [-0.001], b=[0.01] * 10)
    one, many = ({r["series_id"]: r["dsr"] for r in S.deflated_sharpe(s, n).collect()} for n in (1, 1000))
    assert one["a"] > 0.95 and many["a"] < one["a"] and one["b"] is None


def test_weights_do_not_look_ahead(spark):
    random.seed(5)
    a, b = ([random.gauss(0, 0.01) for _ in range(60)] for _ in range(2))
    before = {(r["series_id"], r["d"]): r["w"] for r in S.inverse_vol_weights(S.covered_grid(long_series(spark, a=a, b=b))).collect()}
    a[50] = 9.0
    after = {(r["series_id"], r["d"]): r["w"] for r in S.inverse_vol_weights(S.covered_grid(long_series(spark, a=a, b=b))).collect()}
    cut = DAY + datetime.timedelta(50)
    assert all(after[k] == v for k, v in before.items() if k[1] <= cut)
    assert any(after[k] != v for k, v in before.items() if k[1] > cut)


def test_combination_of_opposed_legs_beats_both(spark):
    a = [0.004 + 0.01 * math.sin(k / 3) for k in range(220)]
    b = [0.004 - 0.01 * math.sin(k / 3) for k in range(220)]
    assert S.combination_vs_best(long_series(spark, a=a, b=b)).first()["beats_best"]
    assert S.combined(long_series(spark, a=a[:20], b=b[:20])).isEmpty()


def test_panel_names_years_and_manifest(spark, tmp_path):
    raw = spark.createDataFrame([("2023-01-02", "x", 1.0), ("2024-01-02", "x", 2.0)], "Datetime string, instrument string, close double")
    p = P.normalised(raw)
    assert p.columns == P.FIELDS and p.where("open IS NULL").count() == 2
    with pytest.raises(ValueError):
        P.normalised(raw.drop("instrument"))
    root = str(tmp_path)
    P.write_years(p, root)
    assert P.read_years(spark, root, 2023, 2024).count() == 2
    with pytest.raises(FileNotFoundError, match="2021, 2022"):
        P.read_years(spark, root, 2021, 2023)
    f = next((tmp_path / "panel" / "year=2023").glob("*.parquet"))
    (tmp_path / "panel" / "year=2023" / f".{f.name}.crc").unlink(missing_ok=True)
    f.write_bytes(next((tmp_path / "panel" / "year=2024").glob("*.parquet")).read_bytes())
    with pytest.raises(ValueError, match="manifest"):
        P.read_years(spark, root, 2023, 2023)


def test_user_code(spark):
    assert user_code.checked("import os\ndef compute(p):\n    return open('x')") == ["import of os", "use of open"]
    p = spark.createDataFrame([(DAY, "a", 1.0), (DAY + datetime.timedelta(1), "a", 3.0)], "trade_date date, ts_code string, close double")
    got = user_code.apply(p, "import math\ndef compute(panel):\n    return [math.log(c) for c in panel['close']]").orderBy("trade_date").collect()
    assert got[1]["score"] == pytest.approx(math.log(3))

import datetime

import pytest
from pyspark.sql import functions as F

from quantloom.functions import expressions as X

ZOO = [
    "Rank(Mean(open, 8) - Mean(open, 30))",
    "-Rank(Ref(high, 3) / low)",
    "CSRank(Sum($amount, 12) / Sum($volume, 12))",
    "Rank(Corr(amount, high, 25)) + Rank(Delta(low, 4))",
    "Sign(Less(high, Mean(high, 15))) * Abs(Delta(open, 2))",
    "Log(Max(amount, 40)) - Log(Min(amount, 40))",
    "If(Greater(high, Ref(high, 6)), Std(low, 12), -Std(low, 24))",
    "Div(Sub(open, low), Sum(Abs(Delta(high, 1)), 9))",
]


@pytest.mark.parametrize("text", ZOO)
def test_corpus_parses_and_compiles(spark, text):
    assert X.is_listed(text)
    assert X.validate(text)["valid"]


@pytest.mark.parametrize("text", ["close if open else low", "close > open", "'a'", "True", "f(x=1)", "close[0]", "", "Rank(*close)", "a and b"])
def test_outside_the_grammar(text):
    with pytest.raises(ValueError):
        X.parse(text)


def test_canonical_forms():
    assert X.serialize(X.parse("Rank(Rank(close))")) == X.serialize(X.parse("Rank(close)"))
    assert X.serialize(X.parse("Corr(close, volume, 5)")) == X.serialize(X.parse("Corr(volume, close, 5)"))
    assert X.serialize(X.parse("close + open")) == X.serialize(X.parse("open + close"))
    assert X.serialize(X.parse("close - open")) != X.serialize(X.parse("open - close"))


def test_hash_buckets_windows_but_similarity_does_not():
    assert X.expr_hash("Mean(close, 19)") == X.expr_hash("Mean($close, 22)")
    assert X.expr_hash("Mean(close, 5)") != X.expr_hash("Mean(close, 60)")
    s = X.similarity(X.parse("Rank(Delta(close, 1))"), X.parse("Rank(Delta(close, 2))"))
    assert 0.5 < s < 1
    assert X.similarity(X.parse("Rank(close)"), X.parse("Corr(high, volume, 10)")) < 0.34
    assert X.similarity(X.parse("close"), X.parse("close")) == 1


def test_most_similar_skips_what_does_not_parse():
    assert X.most_similar("Rank(close)", ["(", "Rank(close)"]) == 1
    assert X.most_similar("Rank(close)", []) == 0
    with pytest.raises(ValueError):
        X.most_similar("(", ["close"])


def test_complexity():
    assert X.complexity(X.parse("Corr(close, volume, 10)")) == {"sl": 6, "pc": 1, "fc": 2}


def test_dialects():
    assert X.to_plain("Rank($Close / $OPEN)") == "Rank(close / open)"
    assert X.to_dollar("Mean(close, 5)") == "Mean($close, 5)"
    assert X.to_dollar("Foo(close)") is None


def bars(spark, closes, code="a"):
    day = datetime.date(2023, 1, 2)
    rows = [(day + datetime.timedelta(k), code, *([c] * 6)) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "trade_date date, ts_code string, open double, high double, low double, close double, volume double, amount double")


def values(spark, closes, text):
    rows = bars(spark, closes).select("trade_date", X.compiled(text).alias("v")).orderBy("trade_date").collect()
    return [r["v"] for r in rows]


def test_windows_are_full(spark):
    assert values(spark, [1.0, 2.0, 4.0, 8.0], "Mean(close, 3)") == [None, None, pytest.approx(7 / 3), pytest.approx(14 / 3)]
    assert values(spark, [1.0, None, 4.0, 8.0, 2.0], "Sum(close, 2)") == [None, None, None, 12.0, 10.0]
    assert values(spark, [1.0, 2.0, 4.0], "Delta(close, 1)") == [None, 1.0, 2.0]


def test_guards(spark):
    assert values(spark, [1.0, 0.0], "1 / close") == [1.0, None]
    assert values(spark, [1.0, 0.0, -1.0], "Log(close)") == [0.0, None, None]
    assert values(spark, [1.0, 1.0, 1.0], "Corr(close, volume, 2)") == [None, None, None]


def test_ranks_break_ties_by_asset_and_keep_nulls(spark):
    p = bars(spark, [2.0], "b").union(bars(spark, [2.0], "a")).union(bars(spark, [1.0], "c")).union(bars(spark, [None], "d"))
    got = {r["ts_code"]: (r["r"], r["s"]) for r in p.select("ts_code", X.compiled("Rank(close)").alias("r"), F.round(X.compiled("CSRank(close)"), 6).alias("s")).collect()}
    assert got == {"c": (1.0, 0.333333), "a": (2.0, 0.833333), "b": (3.0, 0.833333), "d": (None, None)}

import json
import os

from quantloom.operators import records as C
from quantloom.sources import artifacts as A


def test_json_documents_are_replaced_and_set_aside(spark, tmp_path):
    path = f"file://{tmp_path}/a.json"
    assert A.read_json(spark, path, {"n": 0}) == {"n": 0}
    for n in (1, 2):
        A.write_json(spark, path, {"n": n, "t": "é"})
        assert A.read_json(spark, path) == {"n": n, "t": "é"}
    assert [f for f in os.listdir(tmp_path) if f.endswith(".part")] == []
    (tmp_path / "b.json").write_text("{broken")
    assert A.read_json(spark, f"file://{tmp_path}/b.json", []) == [] and (tmp_path / "b.json.corrupt").read_text() == "{broken" and not (tmp_path / "b.json").exists()


def test_metrics_and_listings(spark, tmp_path):
    for k in range(2):
        A.append_metrics(spark.createDataFrame([("done", k, None)], "event string, n int, error string"), f"file://{tmp_path}/m")
    lines = spark.read.json(f"file://{tmp_path}/m")
    assert sorted(r["n"] for r in lines.collect()) == [0, 1] and lines.where("ts IS NULL").isEmpty()
    for name in ("x/b.pdf", "x/y/a.pdf", "c.txt"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_bytes(b"123")
    found = A.files_under(spark, f"file://{tmp_path}/tree").collect()
    assert [r["path"].rpartition("/tree/")[2] for r in found] == ["x/b.pdf", "x/y/a.pdf"] and found[0]["length"] == 3
    assert A.files_under(spark, f"file://{tmp_path}/none").count() == 0


def test_reports(spark, tmp_path):
    rows = [("f|1", "IS", 5.0, 0.1, None, 0.3, 1.5, 0.2), ("f|1", "OOS", 5.0, 0.2, 0.4, 0.3, -1.0, 0.1), ("g", "IS", 5.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("g", "IS", 10.0, 9.0, 9.0, 9.0, 9.0, 9.0)]
    table = spark.createDataFrame(rows, "factor string, window string, bps double, ic double, rank_ic double, icir double, sharpe double, annual double")
    lines = A.bench_report(table, 5.0).split("\n")
    assert lines[0] == "| factor | metric | IS | OOS |" and lines[2] == "| f\\|1 | ic | 0.1 | 0.2 |" and lines[3] == "| f\\|1 | rank_ic | – | 0.4 |" and lines[6] == "| g | ic | 0.0 | – |" and len(lines) == 10
    assert A.cost_report(table).split("\n")[-1] == "| 10.0 | g | 9.0 | – | 9.0 | – |"
    folds = spark.createDataFrame([("f", 1, 0.1, None, 0.2, 0.1, None, None, 0.5)], "factor string, folds int, ic_mean double, ic_std double, rank_ic_mean double, rank_ic_std double, sharpe_mean double, sharpe_std double, positive_share double")
    assert A.fold_report(folds).split("\n")[-1] == "| f | 1 | 0.1 ± – | 0.2 ± 0.1 | 0.5 | – |"
    ranked = spark.createDataFrame([(2, "b", 0.1), (1, "a", 0.2)], "rank int, factor string, ic double")
    text = A.write_sweep(ranked, f"file://{tmp_path}", "sweep", {"grid": 2}, top=1)
    assert text.endswith("| 1 | a | 0.2 |") and "- grid: 2" in text and (tmp_path / "sweep.md").read_text() == text
    assert [r["factor"] for r in json.loads((tmp_path / "sweep.json").read_text())["rows"]] == ["a", "b"]


def test_drift(spark):
    kinds = "expr string, ic double, sharpe double, n int"
    expected = spark.createDataFrame([("a", 0.1, None, 3), ("b", 0.1, 1.0, 3), ("c", 0.1, 1.0, 3), ("d", None, 1.0, None), ("e", 0.1, 1.0, 3)], kinds)
    found = spark.createDataFrame([("a", 0.1 + 1e-8, None, 3), ("b", 0.2, 1.0, 3), ("c", 0.1, 1.0, 4), ("d", None, 1.0, None)], kinds)
    assert {r["expr"]: r["match"] for r in A.drift(expected, found, "expr", ["ic", "sharpe"], ["n"]).collect()} == {"a": True, "b": False, "c": False, "d": True, "e": False}


def test_isolated_records_and_context(spark):
    results = spark.createDataFrame([("mine", True, "Rank(close)", 0.02, 40, None), ("code", True, "", None, 0, None), ("bad", False, "x", None, 0, "boom")], "name string, ok boolean, expression string, ic double, n_returns int, error string")
    got = {r["name"]: r for r in C.isolated_records(results).collect()}
    assert set(got) == {"mine", "code"} and got["mine"]["dialect"] == "expression" and not got["mine"]["is_simulated"] and got["code"]["formula"] == "compute(panel)" and got["code"]["is_simulated"]
    failures = spark.createDataFrame([(k, k, f"E{k % 2}: x", "s" * 200, "h") for k in range(9)], "event_id int, ts int, error string, summary string, hypothesis string")
    context = C.research_context([("a", 0.1)], failures, [["a"]], error="e1", most=3)
    assert context["counts"] == {"samples": 1, "lessons": 3, "chains": 1} and [x["event_id"] for x in context["lessons"]] == [7, 5, 3] and len(context["lessons"][0]["summary"]) == 120

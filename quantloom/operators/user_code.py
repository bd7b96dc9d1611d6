"""User factor code over assets, behind a static allow-list. Spark gives no sandbox: run trusted code only.

Code defines compute(panel), which gets an asset's columns as lists and returns a value for each bar: a list, or a
dict by anything, whose values count in order. NAME and EXPRESSION may be set to strings.

`apply` fails with the first asset that fails. `apply_isolated` runs each asset in a child process with limits of
time and memory, and what goes wrong there becomes that asset's error; the others are scored.
"""

from __future__ import annotations

import ast
import os
import pickle
import resource
import select
import signal
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from quantloom.session import ship

# What user code may import, and names that it may not use.
IMPORTS = ["math", "statistics", "numpy", "pandas"]
BANNED = ["open", "eval", "exec", "compile", "__import__"]


def checked(source: str) -> list[str]:
    """What is wrong with a piece of user code; empty if it may be registered."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return [f"syntax: {e.msg}"]
    wrong = []
    for x in ast.walk(tree):
        names = [a.name for a in x.names] if isinstance(x, ast.Import) else [x.module or ""] if isinstance(x, ast.ImportFrom) else []
        wrong += [f"import of {n}" for n in names if n.split(".")[0] not in IMPORTS]
        if isinstance(x, ast.Name) and x.id in BANNED:
            wrong.append(f"use of {x.id}")
        if isinstance(x, ast.Attribute) and x.attr.startswith("__"):
            wrong.append(f"use of {x.attr}")
    if not any(isinstance(x, ast.FunctionDef) and x.name == "compute" for x in tree.body):
        wrong.append("no function compute(panel)")
    return wrong


def constants(source: str) -> dict[str, str]:
    """NAME and EXPRESSION of the code, where they are set to strings at its top."""
    found = {}
    for x in ast.parse(source).body:
        if isinstance(x, ast.Assign) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str):
            found |= {t.id: x.value.value for t in x.targets if isinstance(t, ast.Name) and t.id in ("NAME", "EXPRESSION")}
    return found


def values_of(out, n: int) -> list[float | None]:
    """What compute returned as n numbers; an error tells what is wrong with it."""
    of_dict = isinstance(out, dict)
    try:
        values = [None if v is None else float(v) for v in (out.values() if of_dict else list(out))]
    except (TypeError, ValueError) as e:
        raise ValueError("compute_dict_not_numeric" if of_dict else "compute_not_numeric") from e
    if len(values) != n:
        raise ValueError(f"compute returned {len(values)} values for {n} bars")
    return values


def limited(work: Callable[[], list], seconds: float, megabytes: int) -> tuple[list | None, str | None]:
    """(what work returns, None) or (None, what went wrong), from a child process that ends with its limits."""
    read, write = os.pipe()
    child = os.fork()
    if child == 0:
        try:
            os.close(read)
            now = int(open("/proc/self/statm").read().split()[0]) * resource.getpagesize()
            resource.setrlimit(resource.RLIMIT_AS, (now + (megabytes << 20),) * 2)
            resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1,) * 2)
            try:
                result = (work(), None)
            except MemoryError:
                result = (None, f"memory: over {megabytes} MB")
            except BaseException as e:  # noqa: BLE001  whatever user code raises is its result
                result = (None, str(e) if isinstance(e, ValueError) and str(e).startswith("compute") else f"{type(e).__name__}: {e}")
            data = memoryview(pickle.dumps(result))
            while data:
                data = data[os.write(write, data) :]
        finally:
            os._exit(0)
    os.close(write)
    parts, end = [], time.monotonic() + seconds
    try:
        while (left := end - time.monotonic()) > 0 and select.select([read], [], [], left)[0]:
            if not (part := os.read(read, 1 << 16)):
                break
            parts.append(part)
        else:
            return None, f"timeout: over {seconds:g} s"
        return pickle.loads(b"".join(parts)) if parts else (None, "the process ended without a result")  # noqa: S301  our own child's
    finally:
        os.close(read)
        os.kill(child, signal.SIGKILL)
        os.waitpid(child, 0)


def apply_isolated(panel: DataFrame, source: str, seconds: float = 20.0, megabytes: int = 512) -> DataFrame:
    """trade_date, ts_code, score, error: as apply, but an asset that fails or goes over a limit has one row with its error."""
    compiled(source)
    ship(panel.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("trade_date")
        columns = {c: g[c].tolist() for c in g.columns}
        values, error = limited(lambda: values_of(compiled(source)(columns), len(g)), seconds, megabytes)
        if error is not None:
            return pd.DataFrame({"trade_date": [None], "ts_code": [g["ts_code"].iloc[0]], "score": [None], "error": [error[:400]]})
        return pd.DataFrame({"trade_date": g["trade_date"], "ts_code": g["ts_code"], "score": values, "error": None})

    return panel.groupBy("ts_code").applyInPandas(run, "trade_date date, ts_code string, score double, error string")


def compiled(source: str) -> Callable:
    if wrong := checked(source):
        raise ValueError("; ".join(wrong))
    scope: dict = {}
    exec(compile(source, "<user factor>", "exec"), scope)  # noqa: S102
    return scope["compute"]


def apply(panel: DataFrame, source: str) -> DataFrame:
    """trade_date, ts_code, score from compute(panel), which gets an asset's columns as lists and returns a value for each bar."""
    compiled(source)
    ship(panel.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("trade_date")
        values = values_of(compiled(source)({c: g[c].tolist() for c in g.columns}), len(g))
        return pd.DataFrame({"trade_date": g["trade_date"], "ts_code": g["ts_code"], "score": values})

    return panel.groupBy("ts_code").applyInPandas(run, "trade_date date, ts_code string, score double")

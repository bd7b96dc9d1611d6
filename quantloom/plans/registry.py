"""Where query modules register a callable and its DuckDB SQL under one name."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


#: The brand-by-month panel, as in sources.panel.
PANEL = """
items AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, p_brand AS ts_code,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey
), p AS (
  SELECT trade_date, ts_code, CAST((max(cents // qty) + min(cents // qty)) // 2 AS DOUBLE) AS open,
    CAST(max(cents // qty) AS DOUBLE) AS high, CAST(min(cents // qty) AS DOUBLE) AS low,
    CAST(sum(cents) // sum(qty) AS DOUBLE) AS close, CAST(sum(qty) AS DOUBLE) AS volume, CAST(sum(cents) AS DOUBLE) AS amount
  FROM items GROUP BY trade_date, ts_code
)"""
SERIES = "PARTITION BY ts_code ORDER BY trade_date"


def rolling(agg: str, x: str, n: int, last: int = 0) -> str:
    """SQL of a rolling aggregate over a full window of n bars that ends `last` bars before the current one."""
    frame = f"OVER ({SERIES} ROWS BETWEEN {n - 1 + last} PRECEDING AND {f'{last} PRECEDING' if last else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {agg}({x}) {frame} END"


def over_panel(value: str, source: str = "p") -> str:
    """SQL for (trade_date, ts_code, value), rounded."""
    return f"WITH {PANEL} SELECT trade_date, ts_code, round({value}, 6) AS value FROM {source}"

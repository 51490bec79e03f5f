"""Pieces of the SQL that queries are checked with."""

from __future__ import annotations

EVENTS = """bars AS (SELECT event_type AS symbol, 'H1' AS timeframe, time_bucket(INTERVAL 1 HOUR, ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume
  FROM events WHERE value > 0 GROUP BY ALL)"""
_ORDER = "{'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey, 'e': l_suppkey, 'f': l_extendedprice}"
LINES = f"""bars AS (SELECT l_returnflag AS symbol, 'D' AS timeframe, time_bucket(INTERVAL 1 DAY, l_shipdate) AS ts, arg_min(l_extendedprice, {_ORDER}) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, arg_max(l_extendedprice, {_ORDER}) AS close, sum(l_quantity)::DOUBLE AS volume
  FROM lineitem WHERE l_extendedprice > 0 GROUP BY symbol, timeframe, time_bucket(INTERVAL 1 DAY, l_shipdate))"""
SERIES = "PARTITION BY symbol, timeframe ORDER BY ts"
RETURNS = f"r AS (SELECT *, close / nullif(lag(close) OVER s, 0) - 1 AS returns FROM bars WINDOW s AS ({SERIES}))"


def frame(n: int) -> str:
    return f"({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, least: int | None = None) -> str:
    """f, with {} for x, over the last n rows."""
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {n if least is None else least} THEN {f.format(x)} OVER {frame(n)} END"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def rounded(columns: dict[str, int] | list[str], digits: int = 6) -> str:
    pairs = columns.items() if isinstance(columns, dict) else [(c, digits) for c in columns]
    return ", ".join(f"round({c}, {d}) AS {c}" for c, d in pairs)

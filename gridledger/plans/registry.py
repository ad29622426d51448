"""Named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, sql: str, uses: Iterable[str] = ()) -> None:
    """A named table expression that checks can build on."""
    _PARTS[name] = (tuple(uses), sql)


def _ordered(names: Iterable[str], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            _ordered(_PARTS[name][0], done)
            done.append(name)
    return done


def with_parts(sql: str, uses: Iterable[str] = ()) -> str:
    names = _ordered(uses, [])
    if not names:
        return sql.strip()
    listed = ",\n".join(f"{n} AS ({_PARTS[n][1].strip()})" for n in names)
    return f"WITH RECURSIVE {listed}\n{sql.strip()}"


def query(name: str, sql: str | None = None, uses: Iterable[str] = ()):
    """Register a query; without SQL it is checked by tests only."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_parts(sql, uses)
        return fn

    return add

"""Registry of runnable queries and the SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from curatorium.sources.projections import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _closure(names: Sequence[str]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen:
            return
        for dep in CTES[name][0]:
            visit(dep)
        seen.append(name)

    for name in names:
        visit(name)
    return seen


def with_ctes(names: Sequence[str], body: str) -> str:
    """Prefix ``body`` (a SELECT, or further CTEs starting with a name, or RECURSIVE and those) with the projections it uses."""
    body = body.strip()
    start = "WITH RECURSIVE" if body.startswith("RECURSIVE ") else "WITH"
    body = body.removeprefix("RECURSIVE ")
    ctes = ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in _closure(names))
    starts_select = body.lower().startswith(("select", "from"))
    if not ctes:
        return body if starts_select else f"{start} {body}"
    return f"{start} {ctes}\n{body}" if starts_select else f"{start} {ctes},\n{body}"


def query(name: str, uses: Sequence[str] = (), sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(uses, sql)
        return fn

    return register

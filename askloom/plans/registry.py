"""Queries with their DuckDB twins, kept side by side.

``@query(name, sql, uses)`` registers a function (spark, folder) -> DataFrame. ``uses``
names shared relations of the oracle (common table expressions) the SQL builds on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: QueryFn
    statement: str | None
    uses: tuple[str, ...] = ()

    @property
    def sql(self) -> str | None:
        return None if self.statement is None else compose(self.statement, self.uses)


QUERIES: dict[str, Entry] = {}
RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {}
#: costly relations that several others read
SHARED = {"post", "raw_terms"}


def relation(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    RELATIONS[name] = (uses, sql.strip())


def compose(sql: str, uses: tuple[str, ...]) -> str:
    """The statement with the relations it needs in front, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in RELATIONS[name][0]:
                visit(dep)
            order.append(name)

    for name in uses:
        visit(name)
    if not order:
        return sql.strip()
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({RELATIONS[n][1]})" for n in order)
    body = sql.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(opening):
            return f"WITH RECURSIVE {head},\n{body[len(opening):]}"
    return f"WITH RECURSIVE {head}\n{body}"


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Entry(fn, sql, uses)
        return fn

    return register

"""Every registered query of the library's own operators, with its SQL where there is one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomery.sources.facts import FACTS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "reachable_files"
MODULES = ("relational", "graphs", "structure", "texts", "clones", "ranking", "history", "scoring", "changes", "feeds", "pages", "pairs", "paths", "nodes", "overlaps", "prose", "trees", "tree_sources", "architecture", "blocks", "html_text", "widening", "ledgers", "frames")


def query(sql: str | None = None, facts: bool = False) -> Callable[[Query], Query]:
    """Register a query under its name. With ``facts`` the SQL may use the fact tables as CTEs."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            if facts:
                more = body.removeprefix("WITH ") if body.startswith("WITH ") else None
                body = f"WITH RECURSIVE {FACTS_SQL.strip()}" + (f",\n{more}" if more else f"\n{body}")
            ORACLE_SQL[f.__name__] = body
        return f

    return add


for _name in MODULES:
    importlib.import_module(f"loomery.plans.{_name}")

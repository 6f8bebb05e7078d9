"""Registration of queries together with the SQL another engine runs to check them."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketframe.catalog.ctes import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def expand_rounding(sql: str) -> str:
    """Rk(expr) -> tie-safe rounding to k digits, the same shift as functions.stats.rnd."""
    pattern = re.compile(r"\bR(\d)\(")
    while (m := pattern.search(sql)):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        digits = int(m.group(1))
        inner = sql[m.end():i - 1]
        shift = repr(1.7 * 10.0 ** -(digits + 4))
        sql = f"{sql[:m.start()]}(ROUND(CAST({inner} AS DOUBLE) + CAST({shift} AS DOUBLE), {digits}) + 0.0){sql[i:]}"
    return sql


def with_ctes(sql: str) -> str:
    """Prepend the input tables (FIXTURES.md) a statement names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    own = set(re.findall(r"(?:\bWITH|\bRECURSIVE|,)\s+(\w+)\s+AS\s+(?:MATERIALIZED\s+)?\(", sql))
    visit(sql)
    needed = [n for n in needed if n not in own]
    heads = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed]
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"WITH\s+RECURSIVE\b", body) else ""
    if body.upper().startswith("WITH"):
        rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body)
        text = f"WITH {recursive}" + ",\n".join(heads + [rest])
    elif heads:
        text = "WITH " + ",\n".join(heads) + "\n" + body
    else:
        text = body
    return expand_rounding(text)


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = with_ctes(sql)
        return fn
    return register

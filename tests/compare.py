"""Run a query on Spark and its SQL twin on DuckDB and compare the tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(base_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(base_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(table, key=repr)


def _kind(text: str) -> str:
    text = text.lower()
    return {
        "varchar": "string", "integer": "int", "timestamp_ntz": "timestamp",
    }.get(text, text)


def differences(spark_df, con, sql) -> list[str]:
    """Empty when names, types and all rows agree."""
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    result = con.execute(sql)
    names, rows = _sorted([r[0] for r in described], result.fetchall())
    got_names, got = _sorted(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    found = []
    if names != got_names:
        return [f"columns differ: {set(names) ^ set(got_names)}"]
    kinds = {r[0]: _kind(r[1]) for r in described}
    for name, kind in spark_df.dtypes:
        if _kind(kind) != kinds[name] and '"null"' not in kinds[name]:
            found.append(f"type of {name}: {kind} against {kinds[name]}")
    if len(rows) != len(got):
        found.append(f"{len(got)} rows against {len(rows)}")
    wrong = [(a, b) for a, b in zip(got, rows) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0]} with columns {names}")
    return found

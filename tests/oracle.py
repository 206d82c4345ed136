"""Run a query and its SQL side by side and compare them the way the driver does."""

from __future__ import annotations

import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(value))
    if isinstance(value, bool):
        return repr(int(value))
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, function, sql):
    """(problem or None, number of rows)."""
    df = function(spark, sf_dir)
    mine = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}", len(mine)
    a, b = _rows(df.columns, mine), _rows(names, theirs)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}", len(mine)
    for x, y in zip(a, b):
        if x != y:
            return f"row {x} against {y}"[:1500], len(mine)
    return None, len(mine)

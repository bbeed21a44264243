"""Compares a query's rows with those of its SQL, as bags, columns by name."""

from __future__ import annotations

import math
import os
from collections import Counter
from datetime import datetime
from decimal import Decimal

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime):
        return value.isoformat()
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark_df, connection, sql: str) -> str | None:
    """None when both sides hold the same rows, else what differs."""
    cursor = connection.execute(sql)
    theirs_columns = [d[0] for d in cursor.description]
    theirs_types = {d[0]: str(d[1]) for d in cursor.description}
    theirs = _bag(theirs_columns, cursor.fetchall())
    if sorted(spark_df.columns) != sorted(theirs_columns):
        return f"columns {sorted(set(spark_df.columns) ^ set(theirs_columns))}"
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    odd = [(c, t, theirs_types[c]) for c, t in spark_df.dtypes if kinds.get(t, t).lower() != theirs_types[c].lower()]
    ours = _bag(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if ours != theirs:
        extra, lacking = ours - theirs, theirs - ours
        return (
            f"{sum(ours.values())} against {sum(theirs.values())} rows, {sum(extra.values())} differ; "
            f"columns {sorted(theirs_columns)}; ours {list(extra)[:3]}; theirs {list(lacking)[:3]}"
        )
    return f"types {odd}" if odd else None

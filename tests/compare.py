"""Compare a registered query with its SQL counterpart: columns, types, rows, values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _table(arrow):
    names = sorted(arrow.column_names)
    types = {n: str(arrow.schema.field(n).type).replace("large_", "") for n in names}
    columns = [arrow.column(n).to_pylist() for n in names]
    rows = sorted(
        (tuple(_plain(v) for v in row) for row in zip(*columns)),
        key=lambda row: tuple((v is None, str(v)) for v in row),
    )
    return names, types, rows


def differences(spark_df, connection, sql: str, limit: int = 5) -> list[str]:
    ours = _table(spark_df.toArrow())
    result = connection.execute(sql)
    theirs = _table(result.to_arrow_table() if hasattr(result, "to_arrow_table") else result.arrow())
    found = []
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} != {theirs[0]}"]
    if ours[1] != theirs[1]:
        found.append(f"types { {k: (ours[1][k], theirs[1][k]) for k in ours[0] if ours[1][k] != theirs[1][k]} }")
    if len(ours[2]) != len(theirs[2]):
        found.append(f"rows {len(ours[2])} != {len(theirs[2])}")
    wrong = [(a, b) for a, b in zip(ours[2], theirs[2]) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, e.g. " + "; ".join(str(w)[:400] for w in wrong[:limit]))
    return found

"""Side-by-side runs: the Spark query against its SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sql_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(frame) -> tuple[list[str], list[str], list[tuple]]:
    """Columns by name, their kinds, and the sorted rows."""
    columns = sorted(frame.columns)
    frame = frame[columns]
    kinds = [frame[c].dtype.kind for c in columns]
    rows = sorted(
        (tuple(None if v is None or v is pd.NA or v != v else v for v in row)
         for row in frame.itertuples(index=False, name=None)),
        key=repr,
    )
    return columns, kinds, rows

"""Rows of a query beside those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, int):
        return float(x) if abs(x) < 1 << 53 else x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([columns[i] for i in order], *sorted([[plain(r[i]) for i in order] for r in rows], key=repr)), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(sql, sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            glob = "/*.parquet" if Path(f"{sf_dir}/{t}.parquet").is_dir() else ""
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet{glob}'")
    found = db.execute(sql)
    return rows_of([d[0] for d in found.description], found.fetchall())

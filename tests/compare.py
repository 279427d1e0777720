"""Compares a DataFrame with DuckDB's rows for the same tables."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return plain(float(value))
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for path in sorted(Path(sf_dir).glob("*.parquet")):
            files = f"{path}/*.parquet" if path.is_dir() else str(path)
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
        result = db.execute(sql)
        names = [d[0] for d in result.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(names), Counter(tuple(plain(row[i]) for i in order) for row in result.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(row[n]) for n in names) for row in df.collect())


def assert_same(df, sf_dir: str, sql: str) -> None:
    names, rows = spark_rows(df)
    their_names, theirs = duck_rows(sf_dir, sql)
    assert names == their_names
    more, less = rows - theirs, theirs - rows
    assert not more and not less, f"{sum(more.values())} rows too many, {sum(less.values())} missing: {list(more)[:2]} / {list(less)[:2]}"

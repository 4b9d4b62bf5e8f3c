"""Query results against DuckDB's: the same columns, and the same rows in any order."""

import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle_rows(sql, folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return sorted(columns), rows_of(columns, found.fetchall())


def assert_same(df, sql, folder):
    columns, expected = oracle_rows(sql, folder)
    assert sorted(df.columns) == columns
    got = rows_of(df.columns, df.collect())
    assert len(got) == len(expected)
    assert got == expected, next((a, b) for a, b in zip(got, expected, strict=True) if a != b)

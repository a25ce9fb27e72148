"""Run a registered query in Spark and its SQL in DuckDB and compare rows."""

from __future__ import annotations

import math

import duckdb

SF_SMALL = "/root/testdata/sf0.001"

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def rows_key(rows):
    return sorted((tuple(_norm(v) for v in r) for r in rows), key=repr)


def compare(spark_df, con, sql):
    """Return (ok, message): same column names, row count and values."""
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: {s_cols} vs {d_cols}"
    order = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(r[i] for i in order) for r in d_rows]
    if len(s_rows) != len(d_rows):
        return False, f"row count {len(s_rows)} vs {len(d_rows)}"
    a, b = rows_key(s_rows), rows_key(d_rows)
    if a != b:
        for x, y in zip(a, b):
            if x != y:
                return False, f"first diff:\n spark {x!r:.600}\n duck  {y!r:.600}"
    return True, f"{len(s_rows)} rows"

"""Runs queries and their SQL side by side, as multisets of rows over columns sorted by name."""

import math

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    import os

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        name = f.removesuffix(".parquet")
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def differs(spark, con, name, query, sql, sf_dir):
    """None, or what is different."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types, strict=True)}
    for c, t in df.dtypes:
        if kinds.get(c) != KINDS.get(t, t):
            return f"{name}: column {c} is {t} and {kinds.get(c)}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(rel.columns, rel.fetchall())
    if a == b:
        return None
    odd = next(((x, y) for x, y in zip(a[1], b[1]) if x != y), None)
    return f"{name}: {a[0]} and {b[0]}, {len(a[1])} and {len(b[1])} rows, first difference {odd}"

"""Compares a Spark result with a DuckDB result the way a reviewer would: names, types, rows."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

FAMILY = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "HUGEINT": "huge",
    "DOUBLE": "double", "FLOAT": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _spark_family(t: str) -> str:
    return {"int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "float": "double"}.get(t, t)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return "\0" if v is None else str(v)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    types = {c[0]: FAMILY.get(str(c[1]), str(c[1]).lower()) for c in rel.description}
    expected = rel.fetchall()
    got_types = {n: _spark_family(t) for n, t in spark_df.dtypes}
    if set(got_types) != set(names):
        return f"columns {sorted(got_types)} vs {sorted(names)}"
    bad = {n: (got_types[n], types[n]) for n in names if got_types[n] != types[n] and "array" not in got_types[n]}
    if bad:
        return f"types {bad}"
    order = sorted(names)
    left = sorted(tuple(_norm(r[n]) for n in order) for r in spark_df.collect())
    right = sorted(tuple(_norm(r[names.index(n)]) for n in order) for r in expected)
    if len(left) != len(right):
        return f"{len(left)} rows vs {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference in {order}:\n  {str(a)[:600]}\n  {str(b)[:600]}"
    return None

"""Run registered queries next to their DuckDB twins and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return str(value)


def bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_notes(df, con, sql: str) -> list[str]:
    """Columns whose types differ between the two engines."""
    other = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [f"{n}: {t} / {other.get(n)}" for n, t in df.dtypes if TYPES.get(t, t) != other.get(n)]


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str, check=None) -> str | None:
    """None where both sides agree, else what differs; ``check`` looks at the DataFrame first."""
    df = fn(spark, sf_dir)
    if check is not None:
        check(df)
    columns, rows = bag(df.columns, df.collect())
    if sql is None:
        return None if rows else f"{name}: no rows"
    result = con.execute(sql)
    other_columns, other = bag([d[0] for d in result.description], result.fetchall())
    if columns != other_columns:
        return f"{name}: columns {columns} != {other_columns}"
    if not rows:
        return f"{name}: no rows"
    if rows != other:
        left, right = rows - other, other - rows
        return (
            f"{name}: {sum(rows.values())} vs {sum(other.values())} rows, {sum(left.values())} differ\n"
            f"  spark  {sorted(left, key=str)[:3]}\n  duckdb {sorted(right, key=str)[:3]}"
        )
    return None


def main(sf: str, pattern: str = "") -> None:
    from cmdprism.catalog import all_oracles, all_queries
    from cmdprism.session import local_session

    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = all_oracles()
    bad = 0
    seen = {}
    for name, fn in all_queries().items():
        if pattern and not any(name.startswith(p) for p in pattern.split(",")):
            continue
        start = time.perf_counter()
        try:
            problem = compare(spark, con, name, fn, oracles.get(name), sf_dir, lambda df: seen.update(df=df))
            notes = type_notes(seen["df"], con, oracles[name]) if name in oracles else []
            if notes:
                print(f"types of {name}:", *notes)
        except Exception as exc:  # noqa: BLE001
            problem = f"{name}: {type(exc).__name__} {str(exc)[:700]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        twin = "sql" if name in oracles else "rows"
        print(f"{mark} {name} [{twin}] {time.perf_counter() - start:.2f}s")
        if problem:
            print(problem)
    print("failures:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])

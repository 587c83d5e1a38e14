"""Run registered queries next to their SQL and compare types, rows and values.

    python -m checks.compare [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from medwarden.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _sort_key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, float, float]:
    start = time.perf_counter()
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=_sort_key)
    spent = time.perf_counter() - start
    if name not in ORACLE:
        return f"rows only: {len(got)}", spent, 0.0
    start = time.perf_counter()
    rel = con.sql(ORACLE[name])
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    if sorted(types) != columns:
        return f"COLUMNS {columns} vs {sorted(types)}", spent, 0.0
    rows = rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    want = sorted(rows, key=_sort_key)
    oracle_spent = time.perf_counter() - start
    bad = [
        (c, t, types[c]) for c, t in df.select(*columns).dtypes if _SAME_TYPE.get(t) != types[c]
    ]
    if bad:
        return f"TYPES {bad}", spent, oracle_spent
    if len(got) != len(want):
        return f"ROWS {len(got)} vs {len(want)}", spent, oracle_spent
    for g, w in zip(got, want, strict=True):
        if not all(_same(x, y) for x, y in zip(g, w, strict=True)):
            return f"VALUES {columns}\n   {g}\n   {w}", spent, oracle_spent
    return f"ok {len(got)}", spent, oracle_spent


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/{args.sf}"
    spark = local_session()
    con = connect(sf_dir)
    failed = 0
    for name in args.names or QUERIES:
        try:
            verdict, spent, oracle_spent = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict, spent, oracle_spent = f"ERROR {str(error)[:900]}", 0.0, 0.0
        if not verdict.startswith(("ok", "rows only")):
            failed += 1
        print(f"{name:32s} {spent:6.2f}s {oracle_spent:6.2f}s  {verdict}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

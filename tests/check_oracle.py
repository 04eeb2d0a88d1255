"""Run Spark queries next to their DuckDB text and compare whole results.

Usage: python tests/check_oracle.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from raresift.plans.analogues import BASE_TABLES  # noqa: E402


TYPES = "--types" in sys.argv


def canonical(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else ("f", value + 0.0)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(canonical(v) for v in value.asDict().values())
    if isinstance(value, dict):
        return tuple(canonical(v) for v in value.values())
    return (type(value).__name__, str(value))


def compare(spark_df, con, sql):
    got_cols = spark_df.columns
    cursor = con.execute(sql)
    want_cols = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}", len(want)
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    have = dict(spark_df.dtypes)
    odd = {d[0]: (have[d[0]], str(d[1])) for d in cursor.description if kinds.get(str(d[1])) != have[d[0]]}
    if odd and TYPES:
        print("  types:", odd, flush=True)
    got = [tuple(r) for r in spark_df.collect()]
    gi = sorted(range(len(got_cols)), key=lambda i: got_cols[i])
    wi = sorted(range(len(want_cols)), key=lambda i: want_cols[i])
    a = sorted((tuple(canonical(r[i]) for i in gi) for r in got), key=repr)
    b = sorted((tuple(canonical(r[i]) for i in wi) for r in want), key=repr)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(b)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        names = sorted(got_cols)
        x, y = bad[0]
        diff = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
        return f"{len(bad)} rows differ, e.g. {diff[:4]}", len(b)
    return None, len(b)


def duck(sf_dir):
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def main():
    from raresift.session import local_session

    sf_dir, prefixes = sys.argv[1], [a for a in sys.argv[2:] if a != "--types"]
    spark = local_session("8")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, build in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem, rows = compare(build(spark, sf_dir), con, oracles[name])
            else:
                problem, rows = None, build(spark, sf_dir).count()
                name += " (rows only)"
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        failed += problem is not None
        flag = "ok  " if problem is None else "FAIL"
        print(f"{flag} {name} rows={rows} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()

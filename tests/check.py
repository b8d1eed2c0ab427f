"""Run registered queries beside their SQL in DuckDB and compare whole results.

Usage: python tests/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "float": "FLOAT",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, repr(v)) for v in row)


def compare(df, con, sql: str) -> list[str]:
    """Problems found; empty when schema and rows agree."""
    problems = []
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    right_types = {r[0]: r[1] for r in described}
    left_types = {name: TYPES.get(t, t) for name, t in df.dtypes}
    if left_types != right_types:
        problems.append(f"schema {left_types} != {right_types}")
        if set(left_types) != set(right_types):
            return problems
    names = sorted(left_types)
    left = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    at = [list(right_types).index(n) for n in names]
    right = sorted((tuple(r[i] for i in at) for r in con.execute(sql).fetchall()), key=_key)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    bad = [(a, b) for a, b in zip(left, right) if _key(a) != _key(b)]
    if bad:
        problems.append(f"{len(bad)} rows differ ({names}), e.g. {bad[0]}")
    if not left:
        problems.append("empty result")
    return problems


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from isopleth.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                problems = compare(fn(spark, sf_dir), con, sqls[name])
                status = "ok" if not problems else "FAIL " + "; ".join(problems)
            else:
                status = f"rows only: {fn(spark, sf_dir).count()}"
                problems = []
        except Exception as e:  # report and go on with the next query
            problems = [str(e)]
            status = "ERROR " + str(e)[:1500]
        failed += bool(problems)
        print(f"{name:24s} {time.time() - start:6.2f}s  {status}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

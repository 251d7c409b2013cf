"""Compare every query with its SQL on one folder of test tables.

Usage: python tests/oracle_check.py [folder] [name prefix…]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from rareflow.session import local_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def compare(spark, con, folder: str, name: str) -> str:
    """Empty if the result matches, else what differs."""
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
    rel = con.sql(entry.oracle_sql()[name])
    names = rel.columns
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=_key)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows"
    bad = [(g, w) for g, w in zip(got, want) if not all(_same(x, y) for x, y in zip(g, w))]
    if bad:
        g, w = bad[0]
        diff = {c: (x, y) for c, x, y in zip(columns, g, w) if not _same(x, y)}
        return f"{len(bad)} of {len(got)} rows differ, first {diff}"
    spark_types = dict(df.dtypes)
    duck_types = {n: str(t) for n, t in zip(names, rel.types)}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    off = {
        c: (spark_types[c], duck_types[c])
        for c in columns
        if spark_types[c] in kinds and kinds[spark_types[c]] != duck_types[c]
    }
    return f"types {off}" if off else ""


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session("8")
    con = connect(folder)
    failed = 0
    for name in sorted(entry.queries()):
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in entry.oracle_sql():
                problem, kind = compare(spark, con, folder, name), "sql"
            else:
                n = entry.queries()[name](spark, folder).count()
                problem, kind = ("" if n else "no rows"), f"rows={n}"
        except Exception as exc:  # report and go on with the next query
            problem, kind = str(exc).splitlines()[0] if str(exc) else repr(exc), "error"
            if prefixes:
                traceback.print_exc()
        took = time.time() - start
        print(f"{'FAIL' if problem else 'ok  '} {took:6.2f}s {name} [{kind}] {problem}", flush=True)
        failed += bool(problem)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())

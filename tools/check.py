"""Run registered queries against their SQL counterparts in DuckDB and report differences and times.

usage: python tools/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voxfield.plans import ORACLES, QUERIES  # noqa: E402
from voxfield.session import local_session  # noqa: E402


TIMES = {"spark": 0.0}


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple(
        (v is None, str(type(v)) if isinstance(v, (list, dict)) else "", str(v) if isinstance(v, (list, dict)) else v)
        if v is not None else (True, "", 0) for v in r))


def difference(spark_df, sql, con):
    spark_columns = spark_df.columns
    left_columns, left = sorted_rows(spark_columns, [tuple(r) for r in spark_df.collect()])
    TIMES["spark"] = time.time()
    result = con.execute(sql)
    right_columns, right = sorted_rows([d[0] for d in result.description], result.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} / {right_columns}", len(left)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}", len(left)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first {bad[0][0]} / {bad[0][1]}", len(left)
    types = [(c, type(a).__name__, type(b).__name__) for c, a, b in zip(left_columns, left[0], right[0])
             if type(a) is not type(b)] if left else []
    return (f"types {types}" if types else ""), len(left)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session()
    con = duckdb.connect()
    for path in glob.glob(os.path.join(args.sf, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    failed = 0
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            if name in ORACLES:
                note, n = difference(df, ORACLES[name], con)
            else:
                note, n = "", len(df.collect())
        except Exception as error:  # report and go on with the next query
            note, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        failed += bool(note)
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if note else 'ok  '} {kind} {name:32s} {n:8d} rows {max(TIMES['spark'] - start, 0.0):6.1f}s + {time.time() - max(start, TIMES['spark']):5.1f}s {note}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

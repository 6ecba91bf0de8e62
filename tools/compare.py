"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tools/compare.py [--sf 0.01] [name-or-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from runledger.catalog import REGISTRY, Tables  # noqa: E402
from runledger.catalog.base import BASE  # noqa: E402
from runledger.plans.session import local_session  # noqa: E402


def canonical(value):
    """One spelling for values the two engines type differently."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return ("n", value)
    if isinstance(value, decimal.Decimal):
        return ("n", int(value)) if value == value.to_integral_value() else ("f", float(value))
    if isinstance(value, float):
        return ("n", int(value)) if math.isfinite(value) and value == int(value) else ("f", round(value, 9))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list | tuple):
        return [canonical(v) for v in value]
    if isinstance(value, dict):
        return sorted((k, canonical(v)) for k, v in value.items())
    return value


def rows_of(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([canonical(r[i]) for i in order]) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session("compare", 8)
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    tables, bad = Tables.of(spark, folder), []
    for name, q in REGISTRY.items():
        if args.names and not any(name.startswith(n) or q.rule.startswith(n) for n in args.names):
            continue
        try:
            t0 = time.time()
            df = q.run(tables)
            got = df.collect()
            t1 = time.time()
            if q.sql is None:
                print(f"rows  {name:28s} {q.rule:14s} {len(got):8d} rows  spark {t1 - t0:6.2f}s", flush=True)
                if not got:
                    bad.append(name)
                continue
            cur = con.execute(q.sql)
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            t2 = time.time()
            a, b = rows_of(df.columns, got), rows_of(cols, want)
            same = sorted(df.columns) == sorted(cols) and a == b
            print(f"{'ok  ' if same else 'DIFF'}  {name:28s} {q.rule:14s} {len(a):8d} rows  spark {t1 - t0:6.2f}s  duckdb {t2 - t1:6.2f}s", flush=True)
            if not same or not a:
                bad.append(name)
            if not same:
                print("   spark", sorted(df.columns), len(a), "duckdb", sorted(cols), len(b))
                sa, sb = set(a), set(b)
                for label, extra in (("spark only", sa - sb), ("duckdb only", sb - sa)):
                    for row in sorted(extra)[:3]:
                        print("   ", label, row[:400])
        except Exception as exc:  # noqa: BLE001 -- report every query
            bad.append(name)
            print(f"FAIL  {name} {q.rule}: {type(exc).__name__}: {str(exc)[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

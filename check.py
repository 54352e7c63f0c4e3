"""Run queries in Spark and their SQL in DuckDB, and compare rows exactly.

usage: python check.py [--sf 0.01] [name or prefix* ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from collections import Counter

import duckdb

from tidemark.plans import load_all
from tidemark.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(table) -> tuple[list[tuple[str, str]], Counter]:
    names = sorted(table.column_names)
    schema = [(n, str(table.schema.field(n).type).replace("large_", "")) for n in names]
    columns = [table.column(n).to_pylist() for n in names]
    return schema, Counter(zip(*columns)) if columns else Counter()


def compare(spark_table, duck_table) -> str | None:
    left_schema, left = canonical(spark_table)
    right_schema, right = canonical(duck_table)
    if left_schema != right_schema:
        return f"schema: {set(left_schema) ^ set(right_schema)}"
    if left != right:
        only_left, only_right = left - right, right - left
        return (
            f"rows {sum(left.values())} vs {sum(right.values())}; "
            f"only spark {sum(only_left.values())}: {list(only_left)[:3]}; "
            f"only duckdb {sum(only_right.values())}: {list(only_right)[:3]}"
        )
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--module")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    registry = load_all()
    chosen = [
        n
        for n, entry in registry.items()
        if (not args.names or any(n == a or (a[-1] == "*" and n.startswith(a[:-1])) for a in args.names))
        and (not args.module or entry.build.__module__.endswith(args.module))
    ]
    spark = local_session(8)
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name in chosen:
        entry = registry[name]
        started = time.time()
        try:
            frame = entry.run(spark, folder)
            ours = frame.toArrow()
            spent = time.time() - started
            if entry.sql is None:
                print(f"ROWS {name} {ours.num_rows} {spent:.1f}s", flush=True)
                continue
            started = time.time()
            theirs = db.sql(entry.sql).to_arrow_table()
            problem = compare(ours, theirs)
            label = "OK  " if problem is None else "DIFF"
            if problem is None and ours.num_rows == 0:
                label = "EMPTY"
            bad += label != "OK  "
            print(f"{label} {name} {ours.num_rows} {spent:.1f}s/{time.time()-started:.1f}s {problem or ''}", flush=True)
        except Exception as error:  # report and go on
            bad += 1
            print(f"ERR  {name} {type(error).__name__} {str(error)[:700]}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

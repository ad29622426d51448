"""Compare registered queries with their SQL: python tests/oracle.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "<null>"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        number = float(value)
        return repr(number + 0.0 if number else 0.0)
    return str(value)


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql: str):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return rows_of(names, result.fetchall())


def difference(left, right) -> str | None:
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left[1])} rows differ, first:\n  {wrong[0][0]}\n  {wrong[0][1]}"
    return None


def main() -> int:
    from gridledger.session import build_session
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names:
        started = time.time()
        try:
            got = spark_rows(entry.queries()[name](spark, sf_dir))
            sql = entry.oracle_sql().get(name)
            middle = time.time()
            problem = difference(got, sql_rows(con, sql)) if sql else None
            shown = "ok" if sql else "rows only"
            print(f"{shown if not problem else 'DIFF'} {name} rows={len(got[1])} {middle - started:.2f}s sql {time.time() - middle:.2f}s")
        except Exception as error:  # report and go on with the next query
            problem = str(error)[:1500]
            print(f"ERROR {name}")
        if problem:
            failed += 1
            print("   ", problem)
    print(f"{len(names) - failed}/{len(names)} fine")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

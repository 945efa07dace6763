"""Run registered queries against their SQL twins: python tests/check.py [scale] [name ...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None if equal, else a description of the first difference."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = df.collect()
    same_kind = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for name, kind in df.dtypes:
        if same_kind.get(kind, kinds[name]) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{str(x)[:300]} != {str(y)[:300]}"
    return None


def main():
    from shelfsift.queries import QUERIES, SQL, load_all
    from shelfsift.session import local_session

    args = sys.argv[1:]
    scale = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    folder = f"/root/testdata/{scale}"
    load_all()
    spark, con = local_session(), connect(folder)
    bad = []
    for name, fn in QUERIES.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in SQL:
                problem = compare(df, con, SQL[name])
                n = "sql"
            else:
                n, problem = f"{len(df.collect())} rows", None
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", ""
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {n} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()

"""Compare registered queries with their DuckDB SQL: python tests/check_oracle.py [sf] [names..]"""

from __future__ import annotations

import datetime
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return repr(value)  # doubles must agree to the last digit
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(con, df, sql: str | None) -> str | None:
    """None when equal, else what differs."""
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None
    cursor = con.execute(sql)
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        missing = [r for r in want[1] if r not in set(got[1])][:3]
        return f"{len(got[1])} rows against {len(want[1])}; only here {extra}; only there {missing}"
    return None if got[1] else "empty on both sides"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tripsearch.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder, chosen = f"/root/testdata/sf{sf}", sys.argv[2:]
    session, con, sqls = local_session(), connect(f"/root/testdata/sf{sf}"), entry.oracle_sql()
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        began = time.time()
        try:
            problem = compare(con, query(session, folder), sqls.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:22s} {time.time() - began:6.1f}s  {problem or 'ok'}", flush=True)

"""Compare registered queries with their SQL: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime | datetime.date):
        return str(value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    theirs = rows_of([c[0] for c in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows and {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1], strict=True) if a != b]
    return f"{len(bad)} of {len(ours[1])} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from lodestone.session import local_session

    spark, con = local_session(), oracle_connection(sys.argv[1])
    names = sys.argv[2:] or list(entry.queries())
    for name in names:
        began = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            if sql is None:
                said = f"{entry.queries()[name](spark, sys.argv[1]).count()} rows, no SQL"
            else:
                said = differences(spark, con, name, entry.queries()[name], sql, sys.argv[1]) or "same"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:1500]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)

"""Run registered queries against their check SQL. `python tests/compare.py [pattern] [sf_dir]`."""

from __future__ import annotations

import datetime as dt
import glob
import os
import re
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "HUGEINT": "hugeint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "DATE": "date", "TIMESTAMP": "timestamp", "TIMESTAMP WITH TIME ZONE": "timestamp",
}


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(float(f"{value:.12g}") + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict) or hasattr(value, "asDict"):
        items = value if isinstance(value, dict) else value.asDict()
        return tuple((k, plain(v)) for k, v in sorted(items.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return repr(value)


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def difference(spark, con, name: str, folder: str, query, sql: str | None):
    """(rows, problem or None)"""
    df = query(spark, folder)
    names = sorted(df.columns)
    got = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    if sql is None:
        return len(got), None
    rel = con.execute(sql)
    head = [(c[0], str(c[1])) for c in rel.description]
    if sorted(c[0] for c in head) != names:
        return len(got), f"columns {names} != {sorted(c[0] for c in head)}"
    index = {c[0]: i for i, c in enumerate(head)}
    want = [tuple(plain(r[index[n]]) for n in names) for r in rel.fetchall()]
    kinds = {n: (dict(df.dtypes)[n], KINDS.get(dict(head)[n], dict(head)[n])) for n in names}
    odd = {n: k for n, k in kinds.items() if k[0] != k[1]}
    if odd:
        return len(got), f"types differ: {odd}"
    if Counter(got) != Counter(want):
        extra, missing = Counter(got) - Counter(want), Counter(want) - Counter(got)
        return len(got), (
            f"{len(got)} vs {len(want)} rows; {sum(extra.values())} only in Spark {list(extra)[:2]}, "
            f"{sum(missing.values())} only in SQL {list(missing)[:2]}"
        )
    return len(got), None


if __name__ == "__main__":
    import __spark_entry__ as entry_module
    from tallyloom.session import build_session

    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    folder = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]",
        extra={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = entry_module.oracle_sql()
    bad = 0
    for name, query in entry_module.queries().items():
        if not re.search(pattern, name):
            continue
        begun = time.time()
        try:
            rows, problem = difference(spark, con, name, folder, query, sqls.get(name))
        except Exception as exc:  # report and go on with the next query
            rows, problem = -1, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        note = "" if name in sqls else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={rows} {time.time() - begun:.1f}s{note} {problem or ''}", flush=True)
    print(f"{bad} failed")
    spark.stop()

"""Run registered queries and their DuckDB twins and compare all values."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb


def canon(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, int):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return sorted((str(k), canon(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if isinstance(v, (list, tuple)):
        return [canon(x) for x in v]
    return v if v is None else str(v)


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def table_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(str([canon(r[i]) for i in order]) for r in rows)


def compare(spark, con, folder, entry):
    """(rows, message); the message is empty when both sides agree."""
    start = time.time()
    df = entry.run(spark, folder)
    left = table_of(df.columns, [tuple(r) for r in df.collect()])
    compare.spark_seconds = time.time() - start
    if entry.sql is None:
        return len(left[1]), ""
    cur = con.execute(entry.sql)
    right = table_of([c[0] for c in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return len(left[1]), f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        extra = [r for r in left[1] if r not in set(right[1])][:2], [r for r in right[1] if r not in set(left[1])][:2]
        return len(left[1]), f"rows {len(left[1])} != {len(right[1])}: {str(extra)[:900]}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return len(left[1]), f"{len(bad)} rows differ: {str(bad[0])[:1500]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from askloom.plans import QUERIES
    from askloom.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    names = [n for n in QUERIES if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) or QUERIES[n].run.__module__.endswith(w) for w in wanted)]
    spark, con, failed = local_session("compare", 8), duck(folder), []
    for n in names:
        t = time.time()
        try:
            rows, msg = compare(spark, con, folder, QUERIES[n])
        except Exception as exc:
            rows, msg = -1, f"{type(exc).__name__}: {str(exc)[:1500]}"
        kind = "ok" if not msg else "FAIL"
        oracle = "" if QUERIES[n].sql else " (rows only)"
        print(f"{kind:4} {n:32} {rows:7} rows spark {getattr(compare, "spark_seconds", 0):6.2f}s all {time.time() - t:6.2f}s{oracle} {msg}", flush=True)
        if msg:
            failed.append(n)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")

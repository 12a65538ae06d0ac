"""Run registered queries in Spark and their SQL twins in DuckDB; compare.

Mirrors the driver's gate: row count, column names (sorted) and an
order-insensitive comparison of the values.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    t2 = time.time()
    problems = []
    if sorted(scols) != sorted(dcols):
        problems.append(f"columns spark={sorted(scols)} duck={sorted(dcols)}")
    if len(srows) != len(drows):
        problems.append(f"rows spark={len(srows)} duck={len(drows)}")
    if not problems:
        a, b = _rows(scols, srows), _rows(dcols, drows)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        if bad:
            problems.append(f"{len(bad)} differing rows, first: spark={bad[0][0]} duck={bad[0][1]}")
    return problems, t1 - t0, t2 - t1, len(srows)


def main(names=None, sf_dir="/root/testdata/sf0.01"):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from tallyspark.session import local_session

    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    failed = []
    for name in names or list(qs):
        if name not in sqls:
            print(f"{name:40s} (no oracle)")
            continue
        try:
            problems, ts, td, n = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            problems, ts, td, n = [f"error: {str(e)[:600]}"], 0, 0, 0
        status = "OK " if not problems else "BAD"
        print(f"{status} {name:40s} rows={n:6d} spark={ts:6.2f}s duck={td:5.2f}s {'; '.join(problems)}", flush=True)
        if problems:
            failed.append(name)
    print("FAILED:", failed)
    return failed


if __name__ == "__main__":
    main(sys.argv[1:] or None)

"""Run registered queries next to their DuckDB oracles and compare results.

Mirrors the correctness gate: same column names, same row count, same
multiset of rows (order-insensitive). Usage::

    python -m parkops.plans.check /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

from parkops.sources.views import DRIVER_TABLES

ORACLE_TABLES = DRIVER_TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in ORACLE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v else str(v)
    if isinstance(v, (dt.datetime, dt.date, dt.time)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((norm(k), norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canon(cols: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return [cols[i] for i in order], out


def spark_type(t: str) -> str:
    m = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
         "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
         "smallint": "SMALLINT", "tinyint": "TINYINT", "timestamp": "TIMESTAMP WITH TIME ZONE"}
    if t.startswith("decimal"):
        return t.upper().replace(" ", "")
    return m.get(t, t.upper())


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    s_cols = list(df.columns)
    t1 = time.time()
    res = {"name": name, "rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "no-oracle"
        return res
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    s_types = {c.lower(): spark_type(t) for c, t in df.dtypes}
    d_types = {c.lower(): str(t).upper().replace(" ", "") for c, t in zip(d_cols, rel.types)}
    tdiff = {c: (s_types[c], d_types.get(c)) for c in s_types
             if s_types[c].replace(" ", "") != (d_types.get(c) or "")}
    if tdiff:
        res["types"] = tdiff
    sc, sr = canon(s_cols, s_rows)
    dc, dr = canon(d_cols, d_rows)
    res["oracle_rows"] = len(d_rows)
    if [c.lower() for c in sc] != [c.lower() for c in dc]:
        res["status"] = f"COLUMNS spark={sc} oracle={dc}"
    elif len(sr) != len(dr):
        res["status"] = "ROWCOUNT"
    elif sr != dr:
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        res["status"] = f"VALUES first diffs={diff}"
    else:
        res["status"] = "ok"
    return res


def main(argv: list[str]) -> int:
    from parkops.plans.oracle_sql import SQL
    from parkops.plans.registry import QUERIES
    from parkops.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, sf_dir, n, QUERIES[n], SQL.get(n))
        except Exception as e:  # report and go on
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("ok", "no-oracle"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Run registered queries next to their DuckDB text and compare values."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

from noticegrid.plans.views import TABLES


def connect(path: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet')")
    return con


def canon(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return repr(value)


def rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(canon(v) for v in row) for row in zip(*columns)) if columns else []


def types(table):
    out = {}
    for field in table.schema:
        t = str(field.type).replace("large_string", "string").replace("string_view", "string")
        out[field.name] = t
    return out


def check(spark, con, name, fn, sql, path):
    """A list of differences; empty when both engines agree."""
    got = fn(spark, path).toArrow()
    want = con.sql(sql).to_arrow_table()
    problems = []
    (gn, gr), (wn, wr) = rows(got), rows(want)
    if gn != wn:
        problems.append(f"columns {gn} <> {wn}")
    elif gr != wr:
        got_set, want_set = set(gr), set(wr)
        extra = [r for r in gr if r not in want_set][:2]
        missing = [r for r in wr if r not in got_set][:2]
        problems.append(f"rows {len(gr)} <> {len(wr)}; spark only {extra}; duckdb only {missing}")
    if not problems and types(got) != types(want):
        gt, wt = types(got), types(want)
        problems.append(f"types {[(n, gt[n], wt[n]) for n in gt if gt[n] != wt[n]]}")
    if not gr:
        problems.append("no rows")
    return problems


def main(argv):
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from noticegrid.session import local_session

    path = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, con, oracle, bad = local_session("8"), connect(path), oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracle:
                problems = check(spark, con, name, fn, oracle[name], path)
            else:
                problems = [] if fn(spark, path).toArrow().num_rows else ["no rows"]
        except Exception as exc:  # noqa: BLE001
            problems = [f"{type(exc).__name__}: {str(exc)[:900]}"]
        bad += bool(problems)
        mark = "ok  " if not problems else "FAIL"
        print(f"{mark} {name} {'S' if name in oracle else 'R'} {time.time() - start:.2f}s", *problems, sep="  ", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])

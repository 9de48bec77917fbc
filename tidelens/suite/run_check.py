"""Compare registered queries with their SQL on one data folder: python -m tidelens.suite.run_check DIR [part..]."""

from __future__ import annotations

import math
import sys
import time
import traceback

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def normal(v):
    """A value in a form both engines share."""
    import datetime as dt
    import decimal

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, str)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, query, sf_dir):
    """(ok, message) of one query."""
    t0 = time.time()
    df = query.run(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if query.sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    t0 = time.time()
    cur = con.execute(query.sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    sql_took = time.time() - t0
    if cols != want_cols:
        return False, f"columns {cols} vs {want_cols}"
    if got != want:
        have, need = set(got), set(want)
        only_a = [r for r in got if r not in need][:3]
        only_b = [r for r in want if r not in have][:3]
        return False, f"{len(got)} vs {len(want)} rows\n   spark {only_a}\n   sql   {only_b}"
    return True, f"{len(got)} rows, {took:.1f}s, sql {sql_took:.1f}s{'  EMPTY' if not got else ''}"


def main(argv):
    import duckdb

    from tidelens import build_session
    from tidelens.suite import all_queries

    sf_dir, parts = argv[0], argv[1:]
    spark = build_session(8, 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name, q in all_queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, message = compare(spark, con, q, sf_dir)
        except Exception as exc:
            ok, message = False, "".join(traceback.format_exception_only(exc))[:1500]
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + message, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

"""Compare the queries of the entry with their SQL: python -m tests.oracle [--sf DIR] [NAME...]."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        v = round(float(v), 5)
        return f"{0.0 if v == 0 else v:.5f}"
    if isinstance(v, int):
        return f"{v:.5f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(d, sql):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings selected_contexts train public_official private_official parent_embeddings codified_laws context_files".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    cur = c.execute(sql)
    return rows_of([x[0] for x in cur.description], cur.fetchall())


def compare(spark, d, name, run, sql):
    t = time.time()
    df = run(spark, d)
    mine = rows_of(df.columns, df.collect())
    t1 = time.time() - t
    if sql is None:
        return f"{name}: {len(mine[1])} rows, no SQL ({t1:.1f} s)"
    t = time.time()
    other = duck(d, sql)
    t2 = time.time() - t
    if mine == other:
        return f"{name}: {len(mine[1])} rows equal ({t1:.1f} s, SQL {t2:.1f} s)"
    diff = [(a, b) for a, b in zip(mine[1], other[1], strict=False) if a != b][:1]
    return f"{name}: DIFFERENT {mine[0]} {other[0]} {len(mine[1])} {len(other[1])} {str(diff)[:600]}"


def main(args):
    from __spark_entry__ import oracle_sql, queries
    from grainlake.session import build_session

    d = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        d, args = args[1], args[2:]
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    q, s = queries(), oracle_sql()
    for name in args or [n for n in q if not n.startswith("p")]:
        try:
            print(compare(spark, d, name, q[name], s.get(name)), flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: ERROR {str(e)[:700]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])

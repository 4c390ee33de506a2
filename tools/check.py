"""Compare registered queries with their SQL: python tools/check.py [sf] [key ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def oracle_rows(sql: str, folder: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(df, sql: str, folder: str) -> str | None:
    """None if both sides agree, else what differs."""
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    want_names, want = oracle_rows(sql, folder)
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"

    def rows(names, data):
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(tuple(canonical(r[i]) for i in order) for r in data)

    a, b = rows(got_names, got), rows(want_names, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g.\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    if not a:
        return "no rows on either side"
    return None


def main() -> int:
    from faultline.catalog import load
    from faultline.session import build_session
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    queries, oracles = load()
    keys = args[1:] or list(queries)
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": os.environ.get("CHECK_PARTITIONS", "8"), "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false", "spark.python.sql.dataFrameDebugging.enabled": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    failed = 0
    for key in keys:
        start = time.time()
        try:
            df = queries[key](spark, folder)
            if key in oracles:
                problem = compare(df, oracles[key], folder)
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as err:  # report and go on with the next query
            problem = f"{type(err).__name__}: {str(err)[:1500]}"
        took = time.time() - start
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {key:28s} {took:6.2f}s {'' if key in oracles else '(rows only) '}{problem or ''}", flush=True)
    print(f"{len(keys) - failed}/{len(keys)} ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

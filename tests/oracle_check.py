"""Compare registered queries with their DuckDB SQL on one scale.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6)
    return v


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(norm(r[i]) for i in order) for r in records), key=lambda t: [str(x) for x in t]
    )


def compare(spark, con, name, run, sql, sf):
    """None if the results agree, else what differs."""
    df = run(spark, sf)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return None if df.columns else "no columns"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(cur.fetchall(), columns)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got == want:
        kinds = {c: t for c, t in zip(columns, [d[1] for d in cur.description])}
        odd = [c for c, t in kinds.items() if "HUGEINT" in str(t) or "DECIMAL" in str(t)]
        return f"oracle types {odd}" if odd else None
    extra = [r for r in got if r not in set(want)][:2]
    missing = [r for r in want if r not in set(got)][:2]
    return f"rows {len(got)} vs {len(want)}; only spark {extra}; only duckdb {missing}"


def main() -> int:
    import __spark_entry__ as entry
    from spanguard.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracle.get(name), args.sf)
        except Exception as e:  # noqa: BLE001 - keep going, report at the end
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        kind = "sql " if name in oracle else "rows"
        print(f"{mark} {kind} {name} {time.time() - start:.1f}s {(problem or '')[:1500]}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())

"""Runs registered queries next to their SQL twins and reports differences.

    python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "tinyint": "TINYINT", "float": "FLOAT", "smallint": "SMALLINT",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def compare(df, con, sql: str) -> list[str]:
    """Problems found; empty when rows, column types and values agree."""
    rel = con.sql(sql)
    ours, theirs = sorted(df.columns), sorted(rel.columns)
    if ours != theirs:
        return [f"columns {ours} != {theirs}"]
    problems = []
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind.upper()) != kinds[name]:
            problems.append(f"type of {name}: {kind} != {kinds[name]}")
    a = Counter(tuple(_plain(r[c]) for c in ours) for r in df.collect())
    at = [rel.columns.index(c) for c in ours]
    b = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    if a != b:
        left, right = list((a - b).elements()), list((b - a).elements())
        problems.append(f"rows {sum(a.values())} vs {sum(b.values())}; {len(left)} / {len(right)} differ")
        for one, other in zip(sorted(left)[:3], sorted(right)[:3]):
            problems.append("  " + str([(c, x, y) for c, x, y in zip(ours, one, other) if x != y]))
    elif not a:
        problems.append("no rows")
    return problems


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tapewright.session import build_session

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    folder = f"/root/testdata/sf{opts.sf}"
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, twins, bad = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if opts.names and not any(n in name for n in opts.names):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            problems = compare(df, con, twins[name]) if name in twins else ([] if df.count() else ["no rows"])
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s{'' if name in twins else ' (rows only)'}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())

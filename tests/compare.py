"""Run registered queries against their SQL twins in DuckDB.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gamelog.sources.samples import SOURCES  # noqa: E402

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SOURCES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def difference(df, con, sql: str) -> str | None:
    """None if both give the same columns, types and rows."""
    relation = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return f"columns {sorted(set(names) ^ set(relation.columns))}"
    ours = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema}
    theirs = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    wrong = {n: (ours[n], theirs[n]) for n in names if ours[n] != theirs[n]}
    if wrong:
        return f"types {wrong}"
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)
    got = sorted((tuple(_cell(v) for v in r) for r in df.select(*names).collect()), key=key)
    want_rows = relation.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall()
    want = sorted((tuple(_cell(v) for v in r) for r in want_rows), key=key)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        cells = [(n, a, b) for n, a, b in zip(names, *bad[0]) if a != b]
        return f"{len(bad)} rows differ, first: {cells[:4]}"
    return None


def main(folder: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from gamelog.session import local_session

    spark, con, failed = local_session(8), connect(folder), 0
    twins = entry.oracle_sql()
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in twins:
                problem = difference(df, con, twins[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # report and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        kind = "sql" if name in twins else "rows"
        print(f"{name:32s} {kind:4s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    target = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(main(target, sys.argv[2:]))

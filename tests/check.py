"""Compare registered queries with their check SQL in DuckDB.

Usage: python tests/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foliary.plans.derived import SOURCES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in SOURCES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return c


def canonical(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for row in rows:
        values = []
        for i in order:
            v = row[i]
            if isinstance(v, (datetime.date, datetime.datetime)):
                v = f"{type(v).__name__}:{v}"
            values.append(f"{type(v).__name__}:{v!r}")
        out.append(tuple(values))
    return [names[i] for i in order], sorted(out)


def compare(spark, con, name: str, folder: str, inspect=None) -> str | None:
    """None when equal, else a description of the difference.  ``inspect`` sees
    the frame before it runs."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, folder)
    if inspect:
        inspect(df)
    got_names, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    sql = e.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_names, want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; e.g. {got[:1]} / {want[:1]}"
    if got != want:
        # line rows up by key for a readable message
        only_got = sorted(set(got) - set(want), key=lambda r: r[::-1])
        only_want = sorted(set(want) - set(got), key=lambda r: r[::-1])
        key = [i for i, n in enumerate(got_names) if n in ("id", "document_id", "name")]
        by_key = {tuple(r[i] for i in key): r for r in only_want}
        diff = [(r, by_key.get(tuple(r[i] for i in key), r)) for r in only_got]
        diff = [d for d in diff if d[0] != d[1]] or [(got[0], want[0])]
        g, w = diff[0]
        cells = [(n, a, b) for n, a, b in zip(got_names, g, w) if a != b]
        return f"{len(diff)} of {len(got)} rows differ, e.g. {str(cells)[:500]}"
    if not got:
        return "no rows"
    return None


def main() -> int:
    from foliary.session import local_session

    import __spark_entry__ as e

    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    names = [n for n in e.queries() if not args or any(n.startswith(a) for a in args)]
    spark, con = local_session(), connect(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        kind = "sql" if name in e.oracle_sql() else "rows"
        print(f"{mark} {name} [{kind}] {time.time() - started:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

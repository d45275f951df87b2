"""Run registered queries on Spark and their SQL on DuckDB and compare the results.

``python -m tests.compare sf0.01 [names...]``
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(v):
    """Engine-neutral value: equal results give equal values."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, int):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def kind(v) -> str:
    return "float" if isinstance(v, float) else type(v).__name__


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def compare(spark, con, name: str, query, sql: str | None, folder: str) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, folder)
    got = df.collect()
    took = time.time() - t0
    cols, left = rows_of(df.columns, got)
    if sql is None:
        return True, f"{name}: {len(left)} rows, no SQL, {took:.1f}s"
    t0 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols2, right = rows_of(names, cur.fetchall())
    sql_took = time.time() - t0
    if cols != cols2:
        return False, f"{name}: columns {cols} against {cols2}"
    if left != right:
        a, b = set(left) - set(right), set(right) - set(left)
        show = lambda s: "\n      ".join(repr(x)[:400] for x in sorted(s, key=repr)[:3])
        return False, (
            f"{name}: {len(left)} rows against {len(right)}, {len(a)}/{len(b)} differ {cols}\n"
            f"   spark {show(a)}\n   sql   {show(b)}"
        )
    return True, f"{name}: {len(left)} rows equal, {took:.1f}s, sql {sql_took:.1f}s"


def main() -> None:
    import __spark_entry__ as entry
    from corpusloom.session import local_session

    folder = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name in queries:
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            ok, said = compare(spark, con, name, queries[name], sql.get(name), folder)
        except Exception as e:  # a failing query must not hide the others
            ok, said = False, f"{name}: {type(e).__name__} {str(e)[:1500]}"
        print(("ok   " if ok else "FAIL ") + said, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()

"""Run named queries next to their SQL and compare rows, column types and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(dtype: str) -> str:
    d = dtype.upper()
    if d in ("BIGINT", "LONG"):
        return "bigint"
    if d in ("INTEGER", "INT", "INT32"):
        return "int"
    if d in ("VARCHAR", "STRING"):
        return "string"
    return d.lower()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return v


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want = rel.fetchall()
    left = {c: _kind(t) for c, t in df.dtypes}
    right = {c: _kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    if left != right:
        return f"schema: spark {left} / sql {right}"
    names = sorted(left)
    gi = [df.columns.index(n) for n in names]
    wi = [rel.columns.index(n) for n in names]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(_norm(r[i]) for i in gi) for r in got), key=key)
    b = sorted((tuple(_norm(r[i]) for i in wi) for r in want), key=key)
    if len(a) != len(b):
        return f"rows: spark {len(a)} / sql {len(b)}; only spark {list(set(map(str,a)) - set(map(str,b)))[:2]}; only sql {list(set(map(str,b)) - set(map(str,a)))[:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"values {names}:\n   spark {str(x)[:600]}\n   sql   {str(y)[:600]}"
    return None if a else "empty result"


def main() -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry

    from sessionloom.context import build_session

    sf = "/root/testdata/sf0.01"
    wanted = sys.argv[1:]
    if wanted and wanted[0].startswith("sf"):
        sf = f"/root/testdata/{wanted.pop(0)}"
    spark, con = build_session(cpus=8), connect(sf)
    oracles, bad, start = entry.oracle_sql(), 0, time.time()
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, fn, oracles[name], sf)
                status = "ok" if problem is None else "DIFF " + problem
            else:
                status = f"rows only: {fn(spark, sf).count()}"
        except Exception as e:  # noqa: BLE001
            status = "ERROR " + str(e)[:700]
        bad += status.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - t:6.2f}s {status}", flush=True)
    print(f"{bad} problems, {time.time() - start:.0f}s")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())

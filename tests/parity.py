"""Run named queries beside their SQL in DuckDB: python tests/parity.py FOLDER [NAME...]."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def canonical(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        return v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str, run, sql: str | None) -> str:
    began = time.time()
    df = run(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - began
    if sql is None:
        return f"rows {len(rows)} ({took:.1f} s), no SQL"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"FAIL columns {df.columns} {names}"
    a, b = canonical(rows, df.columns), canonical(want, names)
    if a != b:
        only_a, only_b = [x for x in a if x not in set(map(tuple, b))][:3] if len(a) < 3000 else [], []
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"FAIL rows {len(a)} and {len(b)}; {diff or (only_a, only_b)}"
    return f"ok {len(rows)} ({took:.1f} s)"


if __name__ == "__main__":
    import __spark_entry__ as e
    from sievegrid.session import build_session

    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:]
    con, q, s = duck(folder), e.queries(), e.oracle_sql()
    for n in names or q:
        try:
            print(n, compare(spark, con, folder, n, q[n], s.get(n)), flush=True)
        except Exception as x:  # noqa: BLE001
            print(n, "ERROR", str(x)[:1500], flush=True)
    sys.stdout.flush()
    os._exit(0)

"""Run registered queries against their SQL oracles.

``python -m tests.compare [sf] [name …]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path
from typing import Any

import duckdb

import __spark_entry__ as entry

DATA = Path("/root/testdata")


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(value: Any) -> Any:
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r))


def kind(dtype: str) -> str:
    dtype = dtype.lower()
    if dtype in ("bigint", "long"):
        return "bigint"
    if dtype in ("int", "integer"):
        return "int"
    return {"string": "varchar"}.get(dtype, dtype)


def check(spark, con, name: str, sf_dir: str) -> tuple[str, int, float]:
    """('ok' | problem, rows, seconds)"""
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows only", len(got), seconds
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: kind(str(d[1])) for d in cursor.description}
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got), seconds
    differ = {n: (kind(t), types[n]) for n, t in df.dtypes if kind(t) != types[n]}
    left, right = rows(df.columns, got), rows(names, want)
    if left != right:
        lost = [r for r in right if r not in set(left)][:3]
        extra = [r for r in left if r not in set(right)][:3]
        return f"values: {len(left)} vs {len(right)} rows; missing {lost}; extra {extra}", len(got), seconds
    return ("ok" if not differ else f"types {differ}"), len(got), seconds


def main() -> None:
    from lanternlog import session

    spark = session.build("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                    "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = str(DATA / (sys.argv[1] if len(sys.argv) > 1 else "sf0.01"))
    wanted = sys.argv[2:] or list(entry.queries())
    con = oracle(sf_dir)
    bad = 0
    for name in wanted:
        try:
            verdict, n, seconds = check(spark, con, name, sf_dir)
        except Exception as error:
            verdict, n, seconds = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0, 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:28} {n:7} {seconds:6.2f}s {verdict}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} good")


if __name__ == "__main__":
    main()

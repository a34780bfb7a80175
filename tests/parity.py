"""Compare queries with their SQL: ``python tests/parity.py [sf_dir] [key ...]``."""

from __future__ import annotations

import functools
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute(f"set temp_directory = '{tempfile.mkdtemp(prefix='duckdb-')}'")
    con.execute("set max_temp_directory_size = '4GB'")
    con.execute("set memory_limit = '12GB'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return names, sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(spark_df, con, sql) -> str | None:
    """None when equal, otherwise what differs."""
    names, left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    other, right = rows_of([c[0] for c in result.description], result.fetchall())
    if names != other:
        return f"columns {names} / {other}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}; e.g. {list(set(left) ^ set(right))[:4]}"
    bad = [(a, b) for a, b in zip(left, right, strict=True) if a != b or [type(v) for v in a] != [type(v) for v in b]]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, e.g. {bad[0][0]} / {bad[0][1]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from roadpulse.plans import queries
    from roadpulse.session import get_session

    # Tables are shared between queries here, since only results are looked at.
    queries.Tables = functools.lru_cache(queries.Tables)

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = get_session(
        "parity",
        **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = database(sf_dir), entry.oracle_sql()
    names = args[1:] or list(entry.queries())
    failed = 0
    for name in names:
        started = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            if name in sqls:
                problem = difference(df, con, sqls[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None
        took = time.time() - started
        n = df.count() if problem is None else "-"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {took:.2f}s {n} rows {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")


if __name__ == "__main__":
    main()

"""Run queries beside their SQL in DuckDB and compare every value.

    python scripts/compare.py /root/testdata/sf0.001 [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from queries import ORACLES, QUERIES  # noqa: E402
from queries.base import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=repr)


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """None when columns, types of numbers and all values agree."""
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in ORACLES:
        return None if got or name.endswith("_empty") else "no rows"
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    mine, theirs = rows_of(df.columns, got), rows_of(columns, want)
    for a, b in zip(mine, theirs):
        if repr(a) != repr(b):
            return f"{sorted(columns)}\n   {a}\n   {b}"
    return None


def main() -> int:
    from plumbline.session import local_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), duck(sf_dir)
    bad = 0
    for name in chosen or QUERIES:
        start = time.time()
        try:
            problem = difference(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        rows = "" if name in ORACLES else " (no SQL)"
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s{rows} {problem or ''}", flush=True)
    print(f"{bad} bad of {len(chosen or QUERIES)}")
    return bad


if __name__ == "__main__":
    sys.exit(main())

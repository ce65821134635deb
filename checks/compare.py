"""Run the checked queries in Spark and in DuckDB and compare whole results.

    python -m checks.compare SF_DIR [QUERY ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from checks.oracle import ORACLE
from checks.registry import QUERIES
from railpulse.session import local_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is not None, str(v)) for v in row))


def difference(df, relation: duckdb.DuckDBPyRelation) -> str | None:
    """The first difference between a Spark and a DuckDB result, or None."""
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} / {sorted(relation.columns)}"
    ours = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = _sorted_rows(relation.columns, relation.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} / {len(theirs)} rows"
    for a, b in zip(ours, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} / {b}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    spark, con = local_session(8), connect(sf_dir)
    wrong = 0
    for name in names or QUERIES:
        began = time.time()
        df = QUERIES[name](spark, sf_dir)
        if name not in ORACLE:
            print(f"{name}: no SQL, {df.count()} rows")
            continue
        found = difference(df, con.sql(ORACLE[name]))
        wrong += found is not None
        print(f"{name}: {found or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    return wrong


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)

"""Run registered queries beside their SQL and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    return value if isinstance(value, (str, bool, type(None))) else float(value) if isinstance(value, float) else int(value)


def rows_of(columns, rows):
    names = sorted(columns)
    at = [list(columns).index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    from __spark_entry__ import oracle_sql, queries

    frame = queries()[name](spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return None if got[1] else "no rows"
    answer = con.sql(sql)
    want = rows_of(answer.columns, answer.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}"
    if not got[1]:
        return "both are empty"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"first difference:\n  spark {a!r:.1500}\n  sql   {b!r:.1500}"
    return None


def main() -> None:
    from __spark_entry__ import queries
    from marginalia.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), []
    for name in wanted or queries():
        start = time.time()
        try:
            found = difference(spark, con, sf_dir, name)
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.2f}s {found or ''}", flush=True)
        failed += [name] if found else []
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()

"""Row-by-row comparison of a Spark result with the SQL result of another engine."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

SOURCES = ("region nation customer supplier part orders lineitem events documents embeddings "
           "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SOURCES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, bool):
        return int(value)
    return value


def normal(rows, columns: list[str]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns and the multisets of rows agree exactly."""
    cursor = con.execute(sql)
    theirs_columns = [d[0] for d in cursor.description]
    theirs = normal(cursor.fetchall(), theirs_columns)
    ours = normal([tuple(r) for r in df.collect()], df.columns)
    found = []
    if sorted(df.columns) != sorted(theirs_columns):
        found.append(f"columns {sorted(df.columns)} / {sorted(theirs_columns)}")
    if ours != theirs:
        found.append(f"rows {sum(ours.values())} / {sum(theirs.values())}; "
                     f"only ours {list((ours - theirs).items())[:2]}; "
                     f"only theirs {list((theirs - ours).items())[:2]}")
    return found


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from riskframe.session import build_session

    spark, con, bad = build_session(cores="8"), connect(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                found, rows = differences(df, con, oracles[name]), ""
            else:
                found, rows = [], f"{df.count()} rows only"
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok':<5}{name:<28}{time.time() - start:6.1f}s {rows if not found else ''}",
              *found, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

"""Run registered queries and their checking SQL side by side.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    got_columns, got = df.columns, df.collect()
    result = con.execute(sql)
    want_columns, want = [d[0] for d in result.description], result.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return [f"columns {sorted(got_columns)} != {sorted(want_columns)}"]
    a, b = rows_of(got_columns, got), rows_of(want_columns, want)
    notes = [] if len(a) == len(b) else [f"{len(a)} rows != {len(b)}"]
    left, right = set(map(repr, a)), set(map(repr, b))
    if a != b and len(left - right) + len(right - left) == 0 and len(a) == len(b):
        return notes
    notes += [f"only spark: {r}" for r in sorted(left - right)[:4]]
    notes += [f"only sql:   {r}" for r in sorted(right - left)[:4]]
    if len(left - right) > 0:
        notes.append(f"{len(left - right)} of {len(a)} rows differ")
    return notes


def main() -> None:
    import __spark_entry__ as entry
    from tipscope.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session("8"), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = []
    for name in sys.argv[2:] or list(queries):
        start = time.time()
        try:
            if name in oracle:
                notes = differences(spark, con, queries[name], oracle[name], sf_dir)
                verdict = "ok" if not notes else "DIFFERS"
            else:
                notes, verdict = [], f"rows {queries[name](spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            notes, verdict = [traceback.format_exc()[-400:], str(error)[:800]], "FAILS"
        if verdict in ("DIFFERS", "FAILS"):
            bad.append(name)
        print(f"{name}: {verdict} ({time.time() - start:.1f}s)", flush=True)
        for note in notes:
            print("   ", note[:900], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()

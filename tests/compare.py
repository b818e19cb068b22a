"""Runs named queries against their SQL at a scale folder: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, query, sql):
    """None when equal, else a short description."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if not want:
        return "no rows"
    if got != want:
        a, b = [r for r in got if r not in want][:2], [r for r in want if r not in got][:2]
        return f"{len(got)} vs {len(want)} rows; only here {a}; only there {b}"
    return None


if __name__ == "__main__":
    from edupulse.session import build_session

    import __spark_entry__

    QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()

    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    wanted = sys.argv[2:] or list(QUERIES)
    session = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        # A low limit sends almost every key through the split paths.
        "spark.edupulse.maxRowsPerGroup": os.environ.get("MAX_ROWS", "1000000")})
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(sf)
    for n in wanted:
        t0 = time.time()
        try:
            if n in ORACLES:
                problem = compare(session, connection, sf, n, QUERIES[n], ORACLES[n])
            else:
                problem = None if QUERIES[n](session, sf).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {n} {time.time() - t0:.1f}s {problem or ''}", flush=True)

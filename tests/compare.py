"""Run the registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    plain = frame[names].astype(object).where(frame[names].notna(), None)
    return sorted((tuple(r) for r in plain.itertuples(index=False)), key=repr)


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> list[str]:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"]
    left, right = rows(spark_frame), rows(sql_frame)
    found = [f"rows {len(left)} / {len(right)}"] if len(left) != len(right) else []
    pairs = [(a, b) for a, b in zip(left, right) if a != b]
    return found + [f"{a}\n   {b}" for a, b in pairs[:2]]


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from cordwood.session import local_session

    sf_dir = sys.argv[1]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        started = time.time()
        try:
            frame = query(spark, sf_dir).toPandas()
            took = time.time() - started
            if name not in sql:
                print(f"NOSQL {name} {len(frame)} rows {took:.1f}s")
                continue
            bad = differences(frame, con.sql(sql[name]).df())
            print(f"{'DIFF' if bad else 'ok'} {name} {len(frame)} rows {took:.1f}s")
            for line in bad:
                print("  ", line)
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name} {str(error)[:600]}")

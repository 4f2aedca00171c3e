"""Compare queries with their SQL: ``python tests/check_queries.py [folder] [name ...]``."""

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return int(v) if float(v).is_integer() else round(float(v), 9)
        if type(v).__name__.startswith("int"):
            return int(v)
        return str(v)

    return sorted(repr(tuple(plain(v) for v in row)) for row in frame.itertuples(index=False, name=None))


def compare(spark, con, folder, name, query, oracle) -> str:
    got = query(spark, folder).toPandas()
    if oracle is None:
        return f"rows only ({len(got)})"
    want = con.execute(oracle).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if a != b:
        extra = [r for r in a if r not in set(b)][:2]
        missing = [r for r in b if r not in set(a)][:2]
        return f"DIFFER {len(a)} vs {len(b)} rows; got {extra} want {missing}"
    return f"ok {len(a)}"


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            found = compare(spark, con, folder, name, query, oracles.get(name))
        except Exception as error:  # report and go on
            found = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        bad += not found.startswith(("ok", "rows only"))
        print(f"@@ {name}: {found}  [{time.time() - began:.1f}s]", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())

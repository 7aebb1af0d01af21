"""Holds registered queries against their SQL: python -m tests.oracle [sf_dir] [names...]"""

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else float(f'{x:.12g}') if isinstance(x, float) else x for x in r))
    return sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    a, b = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    for c in a.columns:
        if str(a[c].dtype).startswith(("int", "Int")) != str(b[c].dtype).startswith(("int", "Int")) and len(a) and not (a[c].isna().any() or b[c].isna().any()):
            return f"types of {c}: {a[c].dtype} and {b[c].dtype}"
    x, y = rows(a), rows(b)
    if x == y:
        return None
    bad = [(p, q) for p, q in zip(x, y, strict=False) if p != q]
    return f"{len(x)} and {len(y)} rows; first difference {bad[:1]}"


def main(sf_dir="/root/testdata/sf0.01", *names):
    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    for n in names or sql:
        t = time.time()
        try:
            why = compare(spark, con, n, queries[n], sql[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if why is None else 'FAIL'} {n} {time.time() - t:.1f}s {why or ''}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])

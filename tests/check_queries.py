"""Runs registered queries and their check SQL side by side: ``check_queries.py FOLDER [NAME ...]``."""

import datetime
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


WHOLE = {"int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE", "string": "VARCHAR"}


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name):
    start = time.time()
    df = queries()[name](spark, folder)
    rows = df.collect()
    spent = time.time() - start
    if name not in oracle_sql():
        return f"rows-only {len(rows)}", spent, 0.0
    start = time.time()
    cursor = con.execute(oracle_sql()[name])
    expected = table([d[0] for d in cursor.description], cursor.fetchall())
    took = time.time() - start
    got = table(df.columns, rows)
    if got[0] != expected[0]:
        return f"COLUMNS {got[0]} != {expected[0]}", spent, took
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    odd = [(c, t, kinds[c]) for c, t in df.dtypes if t in WHOLE and kinds[c] != WHOLE[t]]
    if odd:
        return f"TYPES {odd}", spent, took
    if got[1] == expected[1]:
        return f"ok {len(rows)}", spent, took
    a, b = set(map(repr, got[1])), set(map(repr, expected[1]))
    return (f"DIFF spark {len(got[1])} sql {len(expected[1])}\n   spark only {len(a - b)}: {[x[:700] for x in sorted(a - b)[:2]]}"
            f"\n   sql only {len(b - a)}: {[x[:700] for x in sorted(b - a)[:2]]}"), spent, took


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:] or list(queries())
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in names:
        try:
            result, spent, took = compare(spark, con, folder, name)
        except Exception as e:  # report and go on with the next query
            result, spent, took = f"ERROR {type(e).__name__} {str(e)[:900]}", 0.0, 0.0
        print(f"{name}: {result} [{spent:.1f}s, sql {took:.1f}s]", flush=True)

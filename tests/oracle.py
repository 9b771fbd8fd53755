"""Side-by-side runs of the registered queries in Spark and DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

SAME_TYPE = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]", "smallint": "SMALLINT",
    "array<double>": "DOUBLE[]", "array<bigint>": "BIGINT[]", "date": "DATE",
}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return repr(value)


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, folder):
    """Empty list if both engines agree, else what differs."""
    start = time.time()
    df = query(spark, folder)
    mine = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return spent, len(mine), []
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    theirs = result.fetchall()
    bad = []
    if sorted(names) != sorted(df.columns):
        bad.append(f"columns {sorted(df.columns)} != {sorted(names)}")
        return spent, len(mine), bad
    for c, t in df.dtypes:
        if SAME_TYPE.get(t, t) != types[c]:
            bad.append(f"type of {c}: {t} != {types[c]}")
    a, b = canonical(mine, df.columns), canonical(theirs, names)
    if len(a) != len(b):
        bad.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        left, right = set(a), set(b)
        bad.append(f"only spark {sorted(left - right)[:3]} only duckdb {sorted(right - left)[:3]}")
    return spent, len(mine), bad


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if "/" in sys.argv[1] else f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            spent, rows, bad = compare(spark, con, name, fn, entry.oracle_sql().get(name), folder)
        except Exception as e:  # noqa: BLE001
            spent, rows, bad = 0, 0, [str(e)[:1500]]
        kind = "D" if name in entry.oracle_sql() else "R"
        print(f"{'ok ' if not bad else 'BAD'} {kind} {name} rows={rows} {spent:.2f}s", flush=True)
        for line in bad:
            print("    ", line[:1500])

"""Compare a registered query with its DuckDB SQL, as the driver does: columns by name, rows in any order."""

import datetime
import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(sf_dir).sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns), (name, sorted(df.columns), sorted(rel.columns))
    assert len(got) == len(want), (name, len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (name, a, b)
    return len(got)


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf, names = sys.argv[1], sys.argv[2:]
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name in [n for n in queries if not names or any(n.startswith(x) for x in names)]:
        t = time.time()
        try:
            n = compare(spark, name, queries[name], oracles[name], sf) if name in oracles else queries[name](spark, sf).count()
            print("ok" if name in oracles else "rows only", name, n, f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:
            bad += 1
            print("BAD", name, str(x)[:700], flush=True)
    sys.exit(bad)

"""Runs queries and their SQL over the same tables and says where they differ."""

import math
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return [value(y) for y in x]
    return repr(x) if not isinstance(x, int) or isinstance(x, bool) else repr(int(x))


def differences(spark, con, query, sql, sf_dir):
    """None if both have the same columns and rows."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted([value(r[n]) for n in names] for r in df.collect())
    got = con.execute(sql)
    theirs = [d[0] for d in got.description]
    if sorted(theirs) != names:
        return f"columns {names} against {sorted(theirs)}"
    at = [theirs.index(n) for n in names]
    rows = sorted([value(r[i]) for i in at] for r in got.fetchall())
    if rows == ours:
        return None
    only = [x for x in ours if x not in rows][:3] if len(ours) < 20000 else "?"
    miss = [x for x in rows if x not in ours][:3] if len(ours) < 20000 else "?"
    return f"{len(ours)} rows against {len(rows)}; only here {str(only)[:500]}; only there {str(miss)[:500]}"


if __name__ == "__main__":
    import time

    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    sf = sys.argv[1]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, q, s = duck(sf), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or sorted(q):
        t = time.time()
        try:
            what = differences(spark, con, q[name], s[name], sf) if name in s else f"{q[name](spark, sf).count()} rows, no SQL"
        except Exception as x:
            what = "ERROR " + str(x)[:700]
        print(name, "ok" if what is None else what, f"{time.time() - t:.1f} s", flush=True)

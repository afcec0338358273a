"""Runs queries against their SQL: python tests/verify.py [NAME ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("VERIFY_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 9) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty where both agree in columns and rows."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"{len(got)} and {len(want)} rows; {str(odd)[:600]}"
    return ""


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    cores = os.environ.get("VERIFY_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", cores).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = connect(DATA), entry.queries(), entry.oracle_sql()
    import signal

    signal.signal(signal.SIGALRM, lambda *_: (_ for _ in ()).throw(TimeoutError("out of time")))
    wanted = sys.argv[1:] or [n for n in queries if not n.startswith("op") and n != "pipeline"]
    failed = []
    for name in wanted:
        began = time.time()
        signal.alarm(int(os.environ.get("VERIFY_SECONDS", "120")))
        try:
            if name in oracle:
                said = compare(spark, con, queries[name], oracle[name], DATA)
            else:
                said = "" if queries[name](spark, DATA).count() else "no rows"
        except Exception:  # noqa: BLE001
            said = traceback.format_exc()[-700:]
        signal.alarm(0)
        if said:
            failed.append(name)
        print(f"{'FAIL' if said else 'ok'} {name} {time.time() - began:.1f}s{' (rows only)' if name not in oracle else ''} {said}", flush=True)
        spark.catalog.clearCache()
    print(len(wanted) - len(failed), "of", len(wanted), "agree; failed:", failed)

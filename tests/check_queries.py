"""Run queries against their SQL twins: python tests/check_queries.py [sf_dir] [name part ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from pyspark.sql import SparkSession
from tests.compare import connect, difference


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if len(args) > 1 and not any(a in name for a in args[1:]):
            continue
        t = time.time()
        try:
            got = fn(spark, sf).toPandas()
            dt = time.time() - t
            if name not in sql:
                print(f"rows  {name}: {len(got)} rows {dt:.1f}s", flush=True)
                continue
            t = time.time()
            want = con.execute(sql[name]).df()
            off = difference(got, want)
            print(f"{'ok   ' if off is None else 'DIFF '} {name}: {len(got)} rows {dt:.1f}s sql {time.time() - t:.1f}s {off or ''}", flush=True)
            bad += off is not None
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()

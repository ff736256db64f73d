"""Time every registered query and compare it with its SQL: run_all.py [sf_dir] [name prefix ...]"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from compare import difference, duck  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
wanted = sys.argv[2:]
spark = (
    SparkSession.builder.master("local[8]")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "8g")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.ui.showConsoleProgress", "false")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con = duck(sf_dir)
bad = 0
for name, fn in entry.queries().items():
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    start = time.time()
    try:
        df = fn(spark, sf_dir)
        sql = entry.oracle_sql().get(name)
        if sql is None:
            result = f"rows only: {len(df.collect())}"
        else:
            problem = difference(df, con, sql)
            result = "ok" if problem is None else "DIFF " + problem
    except Exception as exc:  # noqa: BLE001
        result = "ERROR " + str(exc)[:1500]
    bad += result.startswith(("DIFF", "ERROR"))
    print(f"{time.time() - start:6.2f}s {name}: {result}", flush=True)
print("problems:", bad)

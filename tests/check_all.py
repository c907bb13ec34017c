"""python tests/check_all.py SF_DIR [key-part ...]: compare registered queries by hand."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from harness import compare, connect  # noqa: E402

import runlens.plans.queries  # noqa: E402,F401
from runlens.plans.registry import QUERIES  # noqa: E402
from runlens.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf, *parts = sys.argv[1:]
    import os

    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
    spark = build_session("check", "local[8]")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for key, q in QUERIES.items():
        if parts and not any(p in key for p in parts):
            continue
        t = time.time()
        try:
            message = compare(spark, con, key, q, sf)
        except Exception as e:  # report and go on
            message = f"{type(e).__name__}: {str(e)[:600]}"
        mark = "ok  " if not message else "BAD "
        bad += bool(message)
        print(f"{mark}{key:28s} {time.time()-t:6.2f}s {'' if q.sql else '[rows only] '}{message}", flush=True)
    print("bad:", bad, "of", len(QUERIES))

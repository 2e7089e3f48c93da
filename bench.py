"""Benchmark the headline queries.

Runs each query of HEADLINE on $BENCH_SF_DIR (default /root/testdata/sf0.1)
with local[$BENCH_CPUS] and prints one JSON line.  Every query is fully
executed (noop sink: all rows produced, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["match_literal", "match_zones", "mined_chi2", "tune_exact", "cv_predict", "fit_temperature",
            "metrics", "precision_coverage", "flagship"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE

    from labelflow.plans import catalog
    from labelflow.session import local_session
    catalog.load_all()
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="labelflow-bench")

    times: dict[str, float] = {}
    for k in keys:
        t0 = time.time()
        df = catalog.QUERIES[k](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
        print(f"# {k}: {times[k]}s", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))
    spark.stop()


if __name__ == "__main__":
    main()

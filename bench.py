"""Headline-query benchmark.

Runs the headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver); the time is the best of ``BENCH_REPS``
runs after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from aidsift.plans.registry import load_all  # noqa: E402
from aidsift.session import local_session  # noqa: E402

HEADLINE = [
    "determination_counts", "keyword_match", "keyword_match_ngram", "link_cascade",
    "contains_join_token", "interval_join", "chunk_aggregate", "cascade_doc", "tfidf_top_terms",
    "full_outer_nullsafe", "confusion_multilabel", "stratified_split", "dedupe_first",
    "quantile_summary", "enrich", "text_feature_join",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "1"))
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2)
    qs = load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in qs]
    # warm-up: JVM, parquet footers
    qs["value_counts"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        best = None
        for _ in range(reps):
            t0 = time.time()
            qs[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.time() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()

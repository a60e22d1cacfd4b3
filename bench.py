"""Headline benchmark: runs the main recommenders and analytics queries
on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line.

Each query is fully computed with the ``noop`` sink (no driver collect).
Timings are wall-clock seconds per query, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pruned_recommend",        # reference: pruned recommend 0.79 s for one user
    "genre_based_recommend",   # 0.06 s, one user
    "popularity_recommend",    # 0.01 s, one user
    "content_recommend",       # content fit 17.06 s
    "cluster_blend_recommend",  # clustering fit 79.50 s
    "cf_recommend",            # pure CF fit 30.44 s
    "mf_recommend",            # MF fit 47.87 s
    "ensemble_vote",           # full ensemble 77.68 s, one user
    "preference_recommend",    # deep model (fit inside recommend)
    "retrieve_topn",
    "broken_rules",
    "energy_breakdown",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tastemill.plans import load_all
    from tastemill.session import get_spark

    spark = get_spark(f"local[{cpus}]", app="tastemill-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    reg = load_all()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in reg]
    # warm-up: JVM, codegen caches, parquet footers
    reg["popularity_threshold"].build(spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        reg[n].build(spark, sf).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        print(f"# {n}: {times[n]} s", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    # every recommender serves all users of the feedback table in one job
    from tastemill.sources.tables import feedback
    users = feedback(spark, sf).select("user_id").distinct().count()
    print(json.dumps({"metric": "headline_total_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
                      "users_served": users}))
    spark.stop()


if __name__ == "__main__":
    main()

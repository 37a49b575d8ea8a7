"""Time every registered query; one JSON line on stdout.

Per query: one warm-up, then the median of ``BENCH_RUNS`` runs into a noop sink,
building the plan included (some operators look at their input first).
``BENCH_QUERIES`` picks names, comma-separated. ``BENCH_DETAIL=1`` also reports rows and
shuffle bytes per query on stderr.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time


def shuffle_bytes(spark) -> int:
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def main() -> None:
    from stratastats.session import local_session
    from stratastats.workload import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    picked = os.environ.get("BENCH_QUERIES")
    names = picked.split(",") if picked else list(QUERIES)
    spark = local_session("bench")

    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            written_before = shuffle_bytes(spark)
            begin = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(times[1:]), 4)
        line = f"| {name} | {seconds[name]} |"
        if os.environ.get("BENCH_DETAIL"):
            shuffled = shuffle_bytes(spark) - written_before
            line += f" {QUERIES[name](spark, folder).count()} | {shuffled} |"
        print(line, file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total seconds of all queries, median of warm runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

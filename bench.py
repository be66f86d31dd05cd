"""Times the pipeline build and every query; prints one JSON line.

Each query first runs once on the smallest test data, untimed, so that the numbers are
about the queries and not about starting and compiling. Tables are timed as `stage_*`
and `build_*` when they are written; queries are timed reading what was written, the better of
two runs.
"""

import json
import os
import time

from stallkeeper.plans.catalog import all_queries
from stallkeeper.plans.warehouse import testdata_warehouse
from stallkeeper.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_UP_DIR = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
CPUS = os.environ.get("BENCH_CPUS", "8")


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    if os.path.isdir(WARM_UP_DIR):
        for query in queries.values():
            run(query(spark, WARM_UP_DIR))
    seconds = {}
    warehouse = testdata_warehouse(spark, SF_DIR)
    for name in warehouse.staging:
        seconds[f"stage_{name}"] = timed(lambda: warehouse.staging[name])
    for name in warehouse.stored:
        seconds[f"build_{name}"] = timed(lambda: warehouse[name])
    for name, query in queries.items():
        seconds[name] = min(timed(lambda: run(query(spark, SF_DIR))) for _ in range(2))
    print(
        json.dumps(
            {
                "metric": "pipeline build and all queries, after warm-up",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

NAMES = (
    "q18_rescore d01_existing_board c01_attach_to_claims p02_match_candidates b01_flag_pairs n05_w_time n08_near_duplicates "
    "n11_w_amp n17_w_struct n20_fuse_edges x01_k_core x02_connected_components v11_recurrence_parent t02_stream_topic_volume"
).split()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("claimlens-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from claimlens.plans import catalog

    wanted = sys.argv[1:] or NAMES
    times = {}
    for name in wanted:
        # stage tables of a detection run are written once and shared, so n20 carries the signals and
        # x01, x02, v11 only their own work
        t0 = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "claimlens headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

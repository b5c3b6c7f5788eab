"""Times the headline queries: one JSON line.  BENCH_SF_DIR: data; BENCH_CPUS: cores."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("top_vendors", "market_kpis", "trend_yearly_gapfilled", "distributions_platform", "map_points", "contracts_rolled", "award_search_keyset_next", "recent_wins", "platform_parts_rollup", "subcontracts_rollup", "network_subs", "profiles_full_outer", "company_parts_rollup", "nsn_profile_lookup", "nsn_top", "nsn_reference_catalogue", "opportunities_total_over", "search_index", "explorer_page", "spend_tiers")


def main() -> None:
    from pyspark.sql import SparkSession

    from tenderspark import catalogue

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalogue.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()

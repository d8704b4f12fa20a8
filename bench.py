"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: table folder (default sf0.1); BENCH_CPUS: cores; BENCH_RUNS: runs per query (median);
BENCH_QUERIES: comma list of other queries, or ``all``.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from stackfolio.queries import QUERIES

HEADLINES = [
    "tagged_roundtrip", "multivolume_split", "mined_ids", "lookup_two_spellings", "lookup_in_lists", "redirected_ids",
    "agent_variants", "compared_outputs", "reconciled_titles", "points_in_polygon", "facet_panel", "hits_per_node",
    "topic_search", "year_histogram", "hit_neighbours", "volume_numbers", "batch_numbers", "ranked_german",
    "latest_per_user", "changes_applied", "node_paths", "path_texts", "search_all_terms", "search_by_index",
    "isbn_clusters", "ascii_variants", "contract_violations", "structure_profile", "legacy_title_entries",
    "legacy_person_entries", "marc_title_statements", "marc_identifiers",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINES
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["facet_top"](spark, folder).collect()  # start-up is not measured
    seconds: dict[str, float] = {}
    for name in names:
        spent = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(spent), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cores": int(cores), "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

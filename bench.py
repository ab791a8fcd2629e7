"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the data folder and BENCH_CPUS the number of threads. Every query runs twice, and the second time counts, with code
compiled. Building and searching are timed apart; qps is queries per second of a search over all rows as queries.
"""

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "exact_knn_l2",
    "exact_knn_cosine",
    "exact_knn_mips",
    "filtered_knn_label_per_query",
    "filtered_knn_label_join",
    "range_search_l2",
    "label_statistics",
    "medoid",
    "norm_percentiles",
    "graph_bfs_levels",
    "kmeans_clusters",
    "product_quantisation",
    "replay_events",
)


def timed(make, rounds: int = 2) -> float:
    for _ in range(rounds):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
    return took


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pyspark.sql import functions as F

    from nearfield import catalog
    from nearfield.config import IndexConfig
    from nearfield.operators import exact, stats
    from nearfield.plans.index import Index
    from nearfield.storage import materialise

    known, times = catalog.queries(), {}
    for name in HEADLINE:
        times[name] = round(timed(lambda: known[name](spark, SF_DIR)), 3)

    points = materialise(catalog.points(spark, SF_DIR), "bench")
    every = points.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    n = points.count()
    times["exact_all_pairs_top10"] = round(timed(lambda: exact.exact_knn(points, every, 10)), 3)
    began = time.perf_counter()
    index = Index.build(points, IndexConfig(64, degree=32, build_width=50), chunks=16)
    times["graph_build"] = round(time.perf_counter() - began, 3)
    truth = materialise(exact.exact_knn(points, every, 10), "truth")
    figures = {}
    for width in (20, 100):
        took = timed(lambda: index.search(every, 10, width))
        times[f"graph_search_L{width}"] = round(took, 3)
        figures[f"L{width}"] = {"qps": round(n / took, 1), "recall_at_10": round(stats.recall(truth, index.search(every, 10, width), 10).first()[0], 2)}
    took = timed(lambda: index.quantised(every, 10, 100))
    times["quantised_search_L100"] = round(took, 3)
    figures["quantised_L100"] = {"qps": round(n / took, 1), "recall_at_10": round(stats.recall(truth, index.quantised(every, 10, 100), 10).first()[0], 2)}
    figures["exact"] = {"qps": round(n / times["exact_all_pairs_top10"], 1), "recall_at_10": 100.0}
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "search": figures}))
    spark.stop()


if __name__ == "__main__":
    main()

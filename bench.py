"""Times the headline queries over one scale: prints a line of JSON. BENCH_SF_DIR and BENCH_CPUS set where and on how many cores. The stored
indexes, which queries of a session share, are built first; that is timed as ``build_indexes`` and counted in the sum."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from loomwork.plans import catalog
from loomwork.plans.catalog import QUERIES

# Workers import what queries ship by name, from wherever this is started.
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")) if x)

HEADLINE = ["bm25_topk", "dense_topk", "cell_topk", "rrf_hybrid", "collapse_best", "tokenize_df", "chunk_lines", "mine_assoc", "power_score", "power_bands", "midrank_pct", "filter_hard", "filter_soft", "name_ladder", "bigram_dice", "label_fold", "recall_pool", "mean_vector", "change_classify", "rolling_median"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["topn_groups"](spark, sf).collect()  # the session's first job
    began = time.perf_counter()
    catalog.build_indexes(spark, sf)
    seconds = {"build_indexes": round(time.perf_counter() - began, 3)}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query's time also goes to stderr as soon as it is known.  A query that fails is reported as null,
and a run that is ended early still prints the line with what it has.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from linkloom import runtime
from linkloom.plans import catalog

HEADLINE = (
    "rank_measures",
    "link_rank_binary",
    "link_rank_tf",
    "recall_at_n",
    "vocab_shared",
    "features_tfidf",
    "exact_split",
    "corpus_lengths",
    "article_cleanse",
    "web_cleanse",
    "dedup_keep_first",
    "near_dup_survivor",
    "cardinality_buckets",
    "degree_histogram",
    "one_to_one_cascade",
    "experiment_results",
    "svd_leading_component",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("linkloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="linkloom-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds: dict[str, float | None] = {}

    def report() -> None:
        total = round(sum(x for x in seconds.values() if x is not None), 3)
        print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}), flush=True)

    def ended(*_) -> None:
        report()
        os._exit(1)

    signal.signal(signal.SIGTERM, ended)
    for name in names:
        start = time.perf_counter()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # the other queries are still worth their times
            seconds[name] = None
            print(f"{name}: {type(error).__name__}: {str(error)[:300]}", file=sys.stderr, flush=True)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
        runtime.release(spark)
    spark.stop()
    report()


if __name__ == "__main__":
    main()

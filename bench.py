"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   folder of Parquet tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local threads (default 8)
    BENCH_ALL=1    time every registered query instead of the headline ones
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.plans import catalogue
from tidemark.session import build_session

HEADLINE = [
    "daily_news_sums", "daily_news_ratios", "curated_sources", "windowed_search", "page_links", "batch_text_score",
    "dedup_news", "asof_nearest", "rolling_sentiment_filled", "rolling_news_labels", "rolling_beta", "event_study",
    "event_panel", "describe_panel", "auc_gini", "stratified_split", "business_day_roll", "source_lag_search",
    "tfidf_weights", "cosine_pairs", "story_clusters", "jaccard_pairs", "embedding_clusters", "panel_ols_specs", "text_lr",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(catalogue.QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    names = sys.argv[1:] or names
    spark = build_session(cpus, shuffle_partitions=int(cpus))
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the executors
    times = {}
    for name in names:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default: all)
choose data and cores. Each query runs once to warm up, then its median of
``BENCH_RUNS`` (default 3) runs counts; results go to Spark's no-op sink. Training
and streams write files and run once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from kudoscope.plans.queries import QUERIES
from kudoscope.session import build_session

REPEATED = (
    "etl_pipeline", "clean_text", "dedup_clean_text", "review_intelligence", "complaint_summary",
    "product_complaints", "product_narrative", "product_kpis", "quarterly_trend",
    "sentiment_pulse", "class_distribution", "classification_metrics", "mismatch_summary",
    "reviews_by_prediction", "stratified_split", "stratified_sample", "review_feed",
    "aspect_evidence", "search_reviews", "place_pulse", "tfidf_table", "ngram_counts",
    "cosine_topk",
)
ONCE = ("explain_top_words", "train_balanced_lr", "score_reviews", "mmr_select", "stream_score",
        "stream_log_dedup", "stream_windowed_ratio")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = set(sys.argv[1:])
    spark = build_session("kudoscope-bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        # written tables and checkpoints; nothing in it is needed after the run
        "spark.checkpoint.dir": os.environ.get("BENCH_SHARED", tempfile.mkdtemp(prefix="bench-"))})
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds: dict[str, float] = {}
    for name in REPEATED + ONCE:
        if only and name not in only:
            continue
        if name in REPEATED:
            timed(name)
            seconds[name] = round(statistics.median(timed(name) for _ in range(runs)), 3)
        else:
            seconds[name] = round(timed(name), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()

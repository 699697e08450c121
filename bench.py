"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query wall times (seconds, Parquet read to
a no-op sink; one warm-up pass of the first query is excluded)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from simsift.plans import driver_queries  # noqa: E402
from simsift.session import local_session, scratch  # noqa: E402

HEADLINE = [
    "topk_match", "match_outcomes", "hit_rate_at_k", "fuse_mean", "fuse_weighted",
    "accuracy_sweep", "roc_auc", "classification_report", "score_quantile", "score_kde",
    "articulation_truth", "code_scalars",
]
OPTIONAL = ["rake_keywords", "stratified_split", "random_negatives", "hard_negatives",
            "positive_pairs", "fit_projection", "rejected_negatives", "embed_documents",
            "project_pairs", "sample_negatives", "inspection_sample", "keyword_texts",
            "fused_outcomes", "model_delta"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_PARTITIONS", "16")))
    registry = driver_queries.queries()
    names = [n for n in HEADLINE + OPTIONAL if n in registry]
    registry[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        with scratch():
            registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Benchmark: run the headline query keys on $BENCH_SF_DIR with local[$BENCH_CPUS]
and print one JSON line. Each query is fully executed with the ``noop`` sink
(no driver collection)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "corpus_language_summary",
    "corpus_dataset_summary",
    "duplicate_stats",
    "dedup_first",
    "cap_per_language",
    "capped_language_summary",
    "train_dev_split",
    "source_split_70_30",
    "source_policy_sample",
    "label_text_roundtrip",
    "translation_pairs",
    "cs_corpus",
    "cs_label_distribution",
    "clean_text",
    "detect_char_ngram",
    "score_predictions",
    "resource_class_report",
    "labelset_full_match",
    "vocabulary",
    "encode_padded",
    "mean_embedding",
    "stream_profile",
    "eval_sets_report",
    "resume_left_anti",
    "pair_cover",
    "doc_mean_embedding",
    "stream_ingest",
    "evaluate_all",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    from langmix.plans.registry import QUERIES
    from langmix.session import build_session

    spark = build_session(f"local[{cpus}]", app="langmix-bench", shuffle_partitions=int(cpus) * 2)
    # Untimed JIT/codegen warm-up on the smallest fixture (reported as warmup_sec).
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    t_warm = time.time()
    if os.path.isdir(warm_dir):
        for key in ("corpus_language_summary", "cap_per_language", "detect_char_ngram"):
            QUERIES[key](spark, warm_dir).write.format("noop").mode("overwrite").save()
    warmup = round(time.time() - t_warm, 3)
    times: dict[str, float] = {}
    for key in only or HEADLINE:
        t0 = time.time()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
        print(f"# {key}: {times[key]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "total_wall_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "warmup_sec": warmup,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries: BENCH_SF_DIR (default sf0.1), BENCH_CPUS local cores, one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexigraft.plans.catalog import REGISTRY  # noqa: E402

HEADLINE = [
    "A1_line_corpus",
    "A3_lexicon_scan",
    "A5_conll_preparation_scan",
    "B3_segment_lookup",
    "B8_whitespace_tokens",
    "C1_vocabulary_expansion",
    "C7_lexicon_coverage",
    "D1_vector_lookup",
    "D3_morpheme_average",
    "D6_fallback_chain_projected",
    "D12_similarity_initializer",
    "D14_initializer_comparison",
    "D15_gram_matrix",
    "D17_drift_penalty",
    "G1_mean_and_population_std",
    "J9_similarity_top_k",
    "L1_encode_lines",
    "L2_mlm_masking",
    "L3_shuffled_batches",
    "N1_entity_spans",
    "N2_entity_f1",
    "Q3_question_classes",
    "Q4_seeded_split",
    "Q5_context_windows",
    "Q8_best_span",
    "Q10_dataset_scores",
    "R6_results_table",
    "A17_results_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        # small tables: keep every core busy instead of packing a shuffle into one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm_dir = os.environ.get("BENCH_WARM_DIR", sf_dir.replace("sf0.1", "sf0.01"))
    only = set(sys.argv[1:])
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        plan = REGISTRY[name].plan
        plan(spark, warm_dir).write.format("noop").mode("overwrite").save()  # compile, not counted
        start = time.perf_counter()
        plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

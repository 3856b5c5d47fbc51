"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

# One query of each kind of work: scans with expressions, windows, joins, top-k, folds.
HEADLINE = (
    "h07_pair_summary", "h01_run_metrics", "h12_weighted_table", "g01_exact_duplicates", "g07_confidence_feedback", "g12_chain_steps",
    "g18_stable_preferences", "g28_versions", "b01_text_blocks", "b14_chunks", "b17_nearest_rows", "b20_reference_audit", "b32_interval_conflicts",
    "c01_number_mentions", "c16_corpus_candidates", "c22_table_series", "c29_numeric_audit", "c32_chart_long", "d02_budget", "d18_repeated_fragments",
    "e06_resolved_numbers", "e08_html_claims", "f02_bm25_index", "f03_bm25_search", "f04_vector_search", "f07_hybrid_search", "f23_nearest_prototype",
    "i01_visual_fingerprint", "i08_page_text", "j01_collector_batches", "j04_sessions", "j07_cool_down", "j08_sliding_counts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from quire.plans import load_all
    from quire.session import build_session

    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    registry = load_all()
    spark.read.parquet(f"{folder}/region.parquet").count()  # start the workers before timing
    times = {}
    for name in HEADLINE:
        start = time.time()
        # The no-op sink runs the whole plan and keeps the driver out of it.
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

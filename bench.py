"""Times the headline queries: prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "gated_vector_topk gated_vector_topk_all_types vector_topk_per_series vector_topk_batch vector_topk_cells "
    "keyword_idf_topk keyword_stemmed_topk episode_fusion decision_episode_or_ambiguous find_from_clues gated_range_read "
    "season_order_offsets season_slots owner_asof map_episodes near_date_join series_rollup seed_entries fetch_resume "
    "upsert_owned_columns upsert_keep_vector record_upsert progress_report readiness_tiers coverage_report service_copy "
    "clean_html clean_markup clean_plot chunk_paragraphs chunk_overlap chunk_tidying dedup_keep_latest parse_dates "
    "quote_grounding mention_join_longest fuzzy_title tag_overlap_topk review_summary dictionary number_pages "
    "page_arbitration wiki_episode_fields chunk_builder exact_gold_ranks hit_rates question_sample stream_incremental_upsert"
).split()


def run(spark, fn, sf_dir: str) -> float:
    started = time.perf_counter()
    # every column of every row is computed, nothing is written
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    from episodika.plans.registry import QUERIES
    from episodika.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=max(int(cores), 1) if cores.isdigit() else 8)
    wanted = sys.argv[1:] or HEADLINE
    # start the JVM's code paths and the Python workers once, outside the clock
    run(spark, QUERIES["gated_vector_topk"], sf_dir)
    run(spark, QUERIES["clean_html"], sf_dir)
    times, failed = {}, {}
    for name in wanted:
        try:
            times[name] = round(min(run(spark, QUERIES[name], sf_dir) for _ in range(1 if name == "number_pages" else 2)), 3)
        except Exception as error:  # one failing query must not hide the others
            failed[name] = f"{type(error).__name__}: {error}"[:200]
    line = {
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cores": cores,
    }
    if failed:
        line["failed"] = failed
    print(json.dumps(line))


if __name__ == "__main__":
    main()

"""Headline queries, timed end to end (planning, driver-side solves and full output), one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from firmlens.plans import catalog
from firmlens.session import drop_staged, local_session

HEADLINE = [
    "a15_page_text",
    "b02_assembled_documents",
    "b07_fixed_chunks",
    "b08_recursive_chunks",
    "b11_chunk_page_overlap",
    "c02_vector_top_k",
    "c03_keyword_top_k",
    "c06_neighbour_window",
    "c15_strict_answers",
    "d21_harmonised_rows",
    "e03_latest_restatement",
    "f11_extractability_counts",
    "g06_high_quality_keys",
    "h04_transparency_score",
    "h09_group_series",
    "h13_percentile_bands",
    "h25_early_adopter_bands",
    "i07_rank_correlation",
    "i10_panel_one_effect",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    catalog.QUERIES["h12_mean_rating"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    drop_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
